"""N-gram Jaccard join by MinHash banding.

1. Each text becomes the set of hashes of its runs of five words; ``bands`` band
   hashes come from ``bands`` x ``rows`` minima, with band and row counts chosen for
   the target recall at the threshold.
2. Texts with equal sets collapse to one class, so copies are never paired.
3. Classes are shuffled on band hashes, and buckets of one class go.  Pairs are
   verified bucket by bucket, each in the first bucket that both are in.  Where buckets
   overlap so much that the classes they connect are fewer rows than their members (a
   large group of near copies meets itself again in most of its buckets), the connected
   classes are taken as one unit instead; whichever copies fewer rows is chosen for each
   such component, and both find the same pairs.
4. The full sets of classes that share a bucket are moved to their units.  A unit of
   more than ``BLOCK`` classes or ``BLOCK_BYTES`` of sets is cut into blocks and has a
   task a pair of blocks, so none is unbounded; only one text longer than that makes a
   larger block.  Pairs are counted and united, and never leave the task.

The result has one row for each row: its class (the smallest id among the texts
that verified links connect) and its number of links (other rows with a verified
Jaccard of ``threshold`` or more, copies included).  No bucket is capped.

Defined results: words are runs of letters and digits, lowered; a text of one to
four words is one n-gram; a null or wordless text links to nothing and is its
own class.  Repeated rows link to each other as copies do.  If all ids of a class
are null, so is the class."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, connected_components, dropped, no_model, resident, stored, unsized
from .langid import _binary

WORDS, THRESHOLD, RECALL, HASHES, BLOCK, BLOCK_BYTES = 5, 0.8, 0.999, 320, 1024, 8 << 20
#: What a row of a key and a number takes in a broadcast table, with its place in the map.
ROW_BYTES = 256
#: Fixed odd multipliers: of bytes in a word, and of words in an n-gram.
BYTE_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: N-grams whose minima are taken together, and bytes of texts that are cut together.
CHUNK, TEXT_BYTES = 1 << 18, 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows, so the fewest false candidates, that find a
    pair at the threshold with probability ``recall`` using at most ``hashes`` minima."""
    for rows in range(hashes, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(BYTE_BASE), -1, 1 << 64))


def _byte_powers(n: int) -> list[np.ndarray]:
    """``n`` powers, or more, of the base of bytes and of its inverse.  Those for a usual
    chunk are kept for the stage; a longer text's go when it is done."""
    make = lambda m: [_powers(BYTE_BASE, m), _powers(_INVERSE, m)]
    usual = TEXT_BYTES + 1
    return resident("powers", lambda: make(usual)) if n <= usual else make(n)


def ngrams(values: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts whose words are parted by single spaces, and
    where each text's start.  A word's hash is a polynomial modulo 2^64 of its
    bytes, taken from differences of running sums."""
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _byte_powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    inside = values != 32
    edge = np.zeros(len(values), bool)  # first byte of a text
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(inside & (edge | ~np.concatenate([[False], inside[:-1]])))
    final = np.concatenate([edge[1:], [True]])
    ends = np.flatnonzero(inside & (final | ~np.concatenate([inside[1:], [False]]))) + 1
    words = _mixed((sums[ends] - sums[starts]) * down[starts])
    at = np.searchsorted(starts, offsets)  # words before each text
    count = np.diff(at)
    grams = np.zeros(len(words), np.uint64)
    for k in range(n):
        grams[: len(words) - k] = grams[: len(words) - k] * WORD_BASE + words[k:]
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], size)
    out = grams[take]
    for i in np.flatnonzero((count > 0) & (count < n)):
        few = words[at[i] : at[i + 1]]
        h = (few * _powers(WORD_BASE, n)[: len(few)]).sum(dtype=np.uint64)
        out[first[i]] = h ^ np.uint64(count[i])
    return _mixed(out), first


def signatures(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of texts; those without n-grams have zeros."""
    seeds = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, (bands * rows, 2), dtype=np.uint32) | np.uint32(1)
    small = (grams >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, bands), np.uint64)
    if not len(some):
        return out
    cuts = first[:-1][some]
    i = 0
    while i < len(some):  # as many texts as fit a chunk of n-grams, one at least
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK)))
        end = cuts[j] if j < len(some) else first[-1]
        x, c = small[cuts[i] : end], cuts[i:j] - cuts[i]
        for band in range(bands):
            h = np.full(j - i, band + 1, np.uint64)
            for a, b in seeds[band * rows : (band + 1) * rows]:
                h = _mixed(h * WORD_BASE + np.minimum.reduceat((x ^ b) * a, c))
            out[some[i:j], band] = h
        i = j
    return out


def set_digest(grams: np.ndarray) -> bytes | None:
    """128 bits that stand for a sorted set of n-grams; None for the empty set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _clean(text):
    """Lowered words with single spaces, as UTF-8."""
    return F.encode(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{L}\\p{M}\\p{N}]+", " ")), "UTF-8")


def _links(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, bucket: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i in ``left``, j in ``right``, i < j if these are the same) that
    share a band; with ``bucket``, those whose first shared band is that bucket."""
    same = left is right
    x, y = [], []
    for n, i in enumerate(left):
        others = right[n + 1 :] if same else right
        shared = bands[others] == bands[i]
        if bucket is None:
            hit = others[shared.any(axis=1)]
        else:
            hit = others[shared.any(axis=1) & (bands[i][shared.argmax(axis=1)] == bucket)]
        x.append(np.full(len(hit), i))
        y.append(hit)
    x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (x, y))
    size = np.array([len(s) for s in sets], np.int64)
    if len(x) <= 8 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y)], np.int64)
    else:
        owner = np.repeat(np.arange(len(sets)), size)
        _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times > 1
        number = np.cumsum(shared) - 1
        keep = shared[which]
        owner, column = owner[keep], number[which[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        rank = np.zeros(len(sets), np.int64)
        rank[left] = np.arange(len(left))
        col = np.zeros(len(sets), np.int64)
        col[right] = np.arange(len(right))
        table = np.zeros((len(left), len(right)), np.float32)
        for c in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(column, [c, c + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[owner[lo:hi], column[lo:hi] - c] = 1
            table += m[left] @ m[right].T
        common = table[rank[x], col[y]].astype(np.int64)
    good = common >= threshold * (size[x] + size[y] - common) - 1e-9
    return x[good], y[good]


def _verify(threshold: float):
    """Groups of rows with one ``unit`` and ``pair``, in order, to links counted and united."""

    def group(rows: list[dict]):
        sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
        bands = np.array([r["bands"] for r in rows], np.int64)
        block = np.array([r["block"] for r in rows])
        one, two = rows[0]["pair"]["a"], rows[0]["pair"]["b"]
        left = np.flatnonzero(block == one)
        right = left if one == two else np.flatnonzero(block == two)
        x, y = _links(sets, bands, left, right, threshold, rows[0]["unit"]["id"] if rows[0]["unit"]["bucket"] else None)
        weight = np.array([r["copies"] for r in rows], np.int64)
        links = np.bincount(x, weight[y], len(rows)) + np.bincount(y, weight[x], len(rows))
        node = np.array([r["node"] for r in rows])
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in zip(x.tolist(), y.tolist()):
            i, j = find(i), find(j)
            if i != j:
                root[i if node[i] > node[j] else j] = j if node[i] > node[j] else i
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(np.array([node[find(i)] for i in range(len(rows))], np.int64)[some]), pa.array(links[some].astype(np.int64))], ["node", "root", "links"])

    def run(batches):
        no_model()
        now, rows = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if now is not None and (r["unit"], r["pair"]) != now:
                        yield group(rows)
                        rows = []
                    now = r["unit"], r["pair"]
                    rows.append(r)
        if rows:
            yield group(rows)

    return run


def _units(classes: DataFrame, block: int) -> DataFrame:
    """``node, unit(bucket, id), size, bytes`` of the units in which each class that shares a
    bucket is verified."""
    buckets = classes.select("node", F.explode("bands").alias("id"))  # a band's number is part of its hash
    heads = buckets.groupBy("id").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(buckets.join(unsized(heads), "id"))
    comps = stored(connected_components(shared.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))))
    each = unsized(comps)
    sizes = comps.groupBy("root").agg((F.count("*") * F.ceil(F.count("*") / block)).alias("together"))
    apart = shared.groupBy("id").agg(F.first("head").alias("node"), (F.first("n") * F.ceil(F.first("n") / block)).alias("rows"))
    apart = apart.join(each, "node").groupBy("root").agg(F.sum("rows").alias("apart"))
    split = sizes.join(unsized(apart), "root").filter("apart < together").select("root")
    inside = each.join(split, "root", "left_semi").select("node")
    whole = each.join(split, "root", "left_anti").select("node", F.struct(F.lit(False).alias("bucket"), F.col("root").alias("id")).alias("unit"))
    units = stored(whole.union(unsized(shared).join(inside, "node", "left_semi").select("node", F.struct(F.lit(True).alias("bucket"), "id").alias("unit"))))
    dropped(shared, comps)
    return units


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` for every row of ``docs``."""
    bands, per_band = choose_bands(threshold, recall, hashes)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))

    @F.arrow_udf("struct<digest binary, size int, bands array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        values, offsets = _binary(texts)
        digests, sizes, found = [], [], []
        i, n = 0, len(offsets) - 1
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + TEXT_BYTES))))
            grams, first = ngrams(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            found.append(signatures(grams, first, bands, per_band))
            own = [np.unique(grams[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            digests += map(set_digest, own)
            sizes += map(len, own)
            i = j
        flat = np.concatenate(found).view(np.int64) if found else np.zeros((0, bands), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(flat.ravel()))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists], ["digest", "size", "bands"])

    @F.arrow_udf("binary")
    def gram_set(texts: pa.Array) -> pa.Array:
        values, offsets = _binary(texts)
        cut = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        return pa.array([np.unique(ngrams(values[a:b], np.array([0, b - a]))[0]).tobytes() for a, b in cut], pa.binary())

    rows = stored(docs.select("doc_id", "hash", sketch(_clean(F.col("text"))).alias("s")).select("doc_id", "hash", "s.digest", "s.size", F.when(F.col("s.digest").isNotNull(), F.col("s.bands")).alias("bands")))
    # A class's set is made again from one of its texts, told by id and hash.
    kind = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "hash")).alias("from"), F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = stored(kind.withColumn("node", F.monotonically_increasing_id()))
    units, each = _units(classes, block), unsized(classes)
    wanted = units.select("node").distinct().join(each, "node").select("node", F.col("from.doc_id").alias("w_id"), F.col("from.hash").alias("w_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("hash") == F.col("w_hash"))
    few = units.count() * ROW_BYTES <= BROADCAST_BYTES  # beyond that, texts are shuffled to meet their classes
    held = docs.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), same).select("node", gram_set(_clean(F.col("text"))).alias("grams"))
    sets = stored(held.groupBy("node").agg(F.first("grams").alias("grams")))

    sized = units.join(each.select("node", "size"), "node").groupBy("unit").agg(F.count("*").alias("n"), F.sum((8 * F.col("size")).cast("long")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    members = units.join(unsized(sized).select("unit", blocks.alias("blocks")), "unit").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("a"), F.greatest(j, F.col("block")).alias("b")))
    tasks = members.join(unsized(sets), "node").join(each.select("node", "copies", "bands"), "node").select("unit", F.explode(pairs).alias("pair"), "block", "node", "copies", "bands", "grams")
    tasks = tasks.repartition(F.col("unit"), F.col("pair")).sortWithinPartitions("unit", "pair", "node")
    found = stored(tasks.mapInArrow(_verify(threshold), "node long, root long, links long"))
    dropped(sets, units)
    linked = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    labels = connected_components(linked)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = each.select("node", "digest", "copies", "first_id").join(labels, "node", "left").join(unsized(counts), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = unsized(stored(named))
    dropped(found, classes)
    ids = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = named.join(ids, "root").select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    return rows.select("doc_id", "digest").join(unsized(named), "digest", "left").select("doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))
