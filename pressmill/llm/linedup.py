"""Line deduplication by pairwise alignment.

1. Texts with equal lines collapse to one, held by the smallest id; the other
   copies lose every line.
2. The shortest run of adjacent lines with ``min_block_words`` words or more is
   taken from every line on, and back from every line.  Each run, however many
   texts have it, leads all of them to the earliest one, so a run in n texts makes
   n - 1 links and no pair of texts is made twice.  Every line of a block that
   could be deleted is in such a run within the block.
3. Each linked pair is aligned with patience diff: equal ends first, then lines
   that occur once in both in their longest common order, then the gaps between.
4. Runs of aligned lines of ``min_block_words`` words or more are deleted from
   the later text, and then, wherever they stand, all other runs of so many words
   that the earlier text has too, so moved and repeated blocks go as well.  The
   earliest text that has a run always keeps it.

Only keys and lengths of lines are moved, until texts meet their cuts by their
sequence of lines: texts stay where they are if the cuts' size lets them be broadcast,
else both are shuffled.  Lines are compared without white space (as Unicode has
it) at their ends, by 128-bit keys.  In scripts that are written without spaces two letters count as a word.

Defined results: a null or empty text is left as it is, and so is a text that
shares nothing.  Order is by id, nulls last; repeated rows of an id and text are
one document; texts that share an id are told apart by their lines.  An input column
with the name of the result (``out_col``) is replaced by it."""

from __future__ import annotations

import bisect
import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WHITE, dropped, no_model, stored, stripped, unsized

MIN_BLOCK_WORDS = 5
#: Blocks of scripts that are written without spaces between words (Thai and
#: Lao, Myanmar, Khmer, kana, Han); ranges, since a script's name costs a search a letter.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\\x{20000}-\\x{3ffff}"
#: A run that so many texts have, and one of so many parts of all runs, is joined by broadcast.
HOT_TEXTS, HOT_PART = 10_000, 10_000


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of lines that patience diff aligns, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once: dict = {}
        for x in range(i, j):
            once[a[x]] = -1 if a[x] in once else x
        other: dict = {}
        for y in range(k, m):
            other[b[y]] = -1 if b[y] in other else y
        pairs = [(x, other[line]) for line, x in once.items() if x >= 0 and other.get(line, -1) >= 0]
        # Longest increasing run of b's positions: piles, then back from the last.
        tops: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for n, (_, y) in enumerate(pairs):
            pile = bisect.bisect_left(tops, y)
            if pile == len(tops):
                tops.append(y)
                at.append(n)
            else:
                tops[pile], at[pile] = y, n
            back.append(at[pile - 1] if pile else -1)
        n, anchors = at[-1] if at else -1, []
        while n >= 0:
            anchors.append(pairs[n])
            n = back[n]
        for x, y in anchors:  # from the last to the first
            out.append((x, y))
            todo.append((x + 1, j, y + 1, m))
            j, m = x, y
        if anchors:
            todo.append((i, j, k, m))
    return sorted(out)


def runs(keys: list, words: list[int], least: int) -> dict[tuple, list[tuple[int, int]]]:
    """The shortest runs of adjacent lines that have ``least`` words or more, from
    each line with words on and back from it: their lines to places (start, end)."""
    till = [0]
    for n in words:
        till.append(till[-1] + n)
    places: set[tuple[int, int]] = set()
    j = 0
    for i, n in enumerate(words):
        while j < len(words) and till[j] - till[i] < least:
            j += 1
        if n and till[j] - till[i] >= least:
            places.add((i, j))
    i = 0
    for j, n in enumerate(words, 1):
        while till[j] - till[i + 1] >= least and i + 1 < j:
            i += 1
        if n and till[j] - till[i] >= least:
            places.add((i, j))
    out: dict[tuple, list[tuple[int, int]]] = {}
    for i, j in sorted(places):
        out.setdefault(tuple(keys[i:j]), []).append((i, j))
    return out


def blocks(a: list, b: list, words: list[int], least: int) -> list[int]:
    """Positions of ``a`` in aligned runs that have ``least`` words or more, and then
    in what is left in runs of so many words that ``b`` has anywhere."""
    out, run, ends = [], [], None
    for x, y in [*patience(a, b), (-1, -1)]:
        if ends != (x - 1, y - 1):
            if sum(words[i] for i in run) >= least:
                out += run
            run = []
        run.append(x)
        ends = (x, y)
    # Shortest runs cover every common block; lines that only b has count no words.
    size = dict(zip(a, words))
    other = runs(b, [size.get(line, 0) for line in b], least)
    cut = set(out)
    i = 0
    while i < len(a):
        j = i
        while j < len(a) and j not in cut:
            j += 1
        for key, places in runs(a[i:j], words[i:j], least).items():
            if key in other:
                out += [x for start, end in places for x in range(i + start, i + end)]
        i = j + 1
    return sorted(set(out))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text):
    return F.transform(_lines(text), lambda x: F.unhex(F.md5(stripped(x))))


#: White space that ``\\s`` lacks; looked for once a text.
RARE_WHITE = [c for c in WHITE if c not in " \t\n\x0b\x0c\r"]


def _words(text):
    """Words of each line."""
    letters = lambda x: F.char_length(x) - F.char_length(F.regexp_replace(x, f"[{SPACELESS}]", ""))

    def counted(word):
        count = lambda x: F.regexp_count(x, F.lit(word))
        mixed = F.transform(_lines(text), lambda x: count(F.regexp_replace(x, f"[{SPACELESS}]+", " ")) + F.ceil(letters(x) / 2).cast("int"))
        return F.when(text.rlike(f"[{SPACELESS}]"), mixed).otherwise(F.transform(_lines(text), count))

    rare = reduce(lambda a, c: a | F.contains(text, F.lit(c)), RARE_WHITE, F.lit(False))
    return F.when(rare, counted(f"[^{WHITE}]+")).otherwise(counted("\\S+"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_block_words: int = MIN_BLOCK_WORDS, out_col: str = "deduped") -> DataFrame:
    """``docs`` with a struct ``deduped``: ``text`` (what is left; null stays null),
    ``n_lines``, ``n_deleted``, ``copy_of`` (the id that keeps a wholly equal text)."""
    seq = lambda t: F.unhex(F.md5(F.array_join(F.transform(_lines(t), stripped), "\n")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND text <> ''")
    rows = rows.select(F.struct(F.col("id").isNull().alias("none"), "id").alias("id"), seq(F.col("text")).alias("seq"), _keys(F.col("text")).alias("keys"), _words(F.col("text")).alias("words"))
    texts = stored(rows.groupBy("seq").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("words").alias("words")))

    def lead(batches):
        no_model()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [[r[0] if len(r) == 1 else hashlib.md5(b"".join(r)).digest() for r in runs(k, w, min_block_words)] for k, w in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                which = pa.array([n for n, own in enumerate(found) for _ in own], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(which), part.column(3).take(which), pa.array([k for own in found for k in own], pa.binary())], ["seq", "id", "key"])

    lines = stored(texts.select("seq", "keys", "words", "id").mapInArrow(lead, f"seq binary, id {texts.schema['id'].dataType.simpleString()}, key binary"))
    held = stored(lines.groupBy("key").agg(F.count("*").alias("texts"), F.min(F.struct("id", "seq")).alias("holder")).filter("texts > 1").select("key", "texts", F.col("holder.seq").alias("early")))
    hot = F.col("texts") > max(HOT_TEXTS, lines.count() // HOT_PART)
    many = F.broadcast(held.filter(hot).select("key", "early"))  # HOT_PART rows at most
    pairs = lines.join(many, "key", "left_anti").select("seq", "key").join(unsized(held).filter(~hot).select("key", "early"), "key")
    pairs = pairs.union(lines.select("seq", "key").join(many, "key").select(pairs.columns))
    pairs = pairs.filter("seq <> early").groupBy("seq", "early").agg(F.count("*").alias("shared"))
    each = unsized(texts)
    earlier = each.select(F.col("seq").alias("early"), F.col("keys").alias("early_keys"))
    aligned = pairs.join(earlier, "early").join(each.select("seq", "keys", "words"), "seq").select("seq", "keys", "words", "early_keys")

    def align(batches):
        no_model()
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                cols = [c.to_pylist() for c in batch.slice(at, 16).columns]
                got = [(s, cut) for s, a, w, b in zip(*cols) if (cut := blocks(a, b, w, min_block_words))]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.binary()), pa.array([c for _, c in got], pa.list_(pa.int32()))], ["seq", "cut"])

    cuts = aligned.mapInArrow(align, "seq binary, cut array<int>").groupBy("seq").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))
    known = stored(each.select("seq", "id", "copies", F.size("keys").alias("n_lines")).join(cuts, "seq", "left").filter("copies > 1 OR cut IS NOT NULL"))
    dropped(texts, lines, held)
    size = known.agg(F.sum(192 + 4 * F.coalesce(F.size("cut"), F.lit(0)).cast("long"))).first()[0] or 0
    known = known.select(F.col("seq").alias("k_seq"), F.col("id").alias("k_id"), "cut")
    kept = [c for c in docs.columns if c.lower() != out_col.lower()]
    out = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = out.join(F.broadcast(known) if size <= BROADCAST_BYTES else unsized(known), seq(F.col("text")) == F.col("k_seq"), "left")
    first = F.col("k_id").isNull() | F.col("k_id.id").eqNullSafe(F.col("id"))
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(_lines(F.col("text"))))
    # Behind a generator the lines are split once, not for each line that stays.
    cut_lines = F.when(F.col("cut").isNotNull() & first, _lines(F.col("text")))
    out = out.select("row", "id", "text", "k_id", "cut", F.inline(F.array(F.struct(cut_lines.alias("lines"), n_lines.alias("n_lines"), first.alias("first")))))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("cut"))
    rest = F.array_join(F.transform(F.when(F.col("lines").isNotNull(), stay), lambda i: F.get("lines", i)), "\n")
    left = F.when(~F.col("first"), F.lit("")).when(F.col("cut").isNull(), F.col("text")).otherwise(rest)
    gone = F.when(~F.col("first"), F.col("n_lines")).otherwise(F.coalesce(F.size("cut"), F.lit(0)))
    done = F.struct(left.alias("text"), "n_lines", F.when(F.col("cut").isNull() & F.col("first"), F.lit(0)).otherwise(gone).alias("n_deleted"), F.when(~F.col("first"), F.col("k_id.id")).alias("copy_of"))
    # The row is opened last, or its own columns could be taken for those named here.
    return out.select("row", done.alias("done")).select("row.*", F.col("done").alias(out_col))
