"""Alignment of the tokens of two tokenizers, and counts of the pairs that end together.

A text with a space before it is cut by a byte-level BPE (A) and by a sentence-piece
model that adds the space itself (B).  Both cover the same bytes, so the ends of their
tokens are two rising lists of byte offsets.  The shorter list drives a galloping
intersection: each end is looked for from where an earlier one was found, by steps that
double and then by halving what they span.  Ends in both lists cut the tokens into
groups, and differences of their ranks say how many tokens of A and of B a group has.
The last tokens of a group are a link: their byte ranges end together.

Texts are read once.  Links stay beside their row as packed numbers (``a * size of B +
b``, unsigned, 32 bits where they do); tasks count them before anything is shuffled, so a
pair costs one row a task however often it occurs.  Distinct pairs are bounded by the
vocabularies; they go to the tasks in blocks of bounded size.

Defined results: a null or empty text has no tokens, and neither has one that one of the
tokenizers doesn't give back byte for byte (text that B normalises, say).  Strings of
special tokens are plain text.  Repeated rows count as often as they occur; null ids are
no case of their own.  An input column with the name of a result (``out_col``) is
replaced by it."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORDS, _byte_letters
from .common import resident

#: Characters that are aligned together; ends for which one search starts from the last.
CHUNK, BLOCK = 1 << 19, 16
#: Pairs in a block that is broadcast (32 bytes each), and those a task holds uncounted.
BLOCK_PAIRS, HELD_LINKS = 1 << 20, 1 << 21


def common_ends(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in two rising lists of what both have, by galloping through ``long``.

    Every ``BLOCK``-th end is searched for from the place of the one before; the ends
    between start at the place of their block's first, all at once."""
    n, m = len(short), len(long)
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    view, at, firsts = memoryview(long), 0, []
    for end in short[::BLOCK].tolist():
        low, step = at, 1
        while at < m and view[at] < end:
            low, at, step = at + 1, at + step, step * 2
        at = bisect_left(view, end, low, min(at, m))
        firsts.append(at)
    low = np.repeat(np.array(firsts, np.int64), BLOCK)[:n]
    high, step, todo = low.copy(), 1, np.arange(n)
    while len(todo):  # double the step until an end isn't passed any more
        at = high[todo]
        passed = (at < m) & (long[np.minimum(at, m - 1)] < short[todo])
        todo, at = todo[passed], at[passed]
        low[todo], high[todo] = at + 1, np.minimum(at + step, m)
        step *= 2
    todo = np.flatnonzero(low < high)
    while len(todo):  # halve what is left
        mid = (low[todo] + high[todo]) // 2
        passed = long[mid] < short[todo]
        low[todo], high[todo] = np.where(passed, mid + 1, low[todo]), np.where(passed, high[todo], mid)
        todo = todo[low[todo] < high[todo]]
    hit = np.flatnonzero((low < m) & (long[np.minimum(low, m - 1)] == short))
    return hit, low[hit]


class Pair:
    """The two tokenizers, with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = _byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [spec["model"]["vocab"][x + y] for x, y in merges]
        if made != sorted(made):
            raise ValueError("the merges of the first tokenizer aren't in the order of its ids")
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.sizes = [np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes)]
        self.b_count = len(self.b_bytes)
        self.code = np.dtype("<u4" if len(self.a_bytes) * self.b_count < 1 << 32 else "<u8")
        told = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.a_said, self.a_last = told(len(self.a_bytes), ","), told(len(self.a_bytes), "|")
        self.b_said, self.b_last = told(self.b_count, ","), told(self.b_count, ";")

    def align(self, texts: list[str | None]) -> list[tuple[int, int, str, bytes]]:
        """For each text: how many tokens, the groups and the packed links."""
        out: list[tuple[int, int, str, bytes]] = [(0, 0, "", b"")] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        rows = []
        for i, b in zip(full, self.b.encode([texts[i] for i in full], num_threads=1) if full else []):
            whole = " " + texts[i]
            a, raw = self.a.encode_ordinary(whole), whole.encode()
            if b"".join(map(self.b_bytes.__getitem__, b)) == raw and b"".join(map(self.a_bytes.__getitem__, a)) == raw:
                rows.append((i, a, b))
        if not rows:
            return out
        # All texts of the chunk in one: both tokenizers end a text at the same byte.
        a, b = (np.concatenate([np.array(r[side], np.int64) for r in rows]) for side in (1, 2))
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        if len(a) <= len(b):
            a_cut, b_cut = common_ends(a_ends, b_ends)
        else:
            b_cut, a_cut = common_ends(b_ends, a_ends)
        links = (a[a_cut] * self.b_count + b[b_cut]).astype(self.code)
        # A group's tokens: those of A after the tokens of B in the groups before, then B's.
        a_of, b_of = np.diff(a_cut, prepend=-1), np.diff(b_cut, prepend=-1)
        a_at = np.arange(len(a)) + np.repeat(b_cut - b_of + 1, a_of)
        b_at = np.arange(len(b)) + np.repeat(a_cut + 1, b_of)
        said = np.empty(len(a) + len(b), object)
        said[a_at], said[b_at] = self.a_said[a], self.b_said[b]
        said[a_at[a_cut]], said[b_at[b_cut]] = self.a_last[a[a_cut]], self.b_last[b[b_cut]]
        said = said.tolist()
        token = link = 0
        ends = np.searchsorted(a_cut, np.cumsum([len(r[1]) for r in rows]) - 1).tolist()
        for (i, own_a, own_b), end in zip(rows, ends):
            till = token + len(own_a) + len(own_b)
            out[i] = (len(own_a), len(own_b), "".join(said[token:till])[:-1], links[link : end + 1].tobytes())
            token, link = till, end + 1
        return out


def tokenizers(a_path: str, b_path: str) -> Pair:
    """The tokenizers, read once a worker."""
    return resident(("align", a_path, b_path), lambda: Pair(a_path, b_path))


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", out_col: str = "aligned", chunk_chars: int = CHUNK) -> DataFrame:
    """``docs`` with a struct ``aligned``: ``n_a``, ``n_b``, ``groups`` (``a1,a2|b1;a3|b2``:
    ids of A and of B, in order) and ``links`` (packed).

    The paths are those of the tokenizer files; every worker must be able to open them."""

    @F.arrow_udf("struct<n_a: bigint, n_b: bigint, groups: string, links: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = tokenizers(a_path, b_path)
        for texts in batches:
            chunk, size = [], 0
            for n in range(len(texts) + 1):
                text = texts[n].as_py() if n < len(texts) else None
                if n == len(texts) or chunk and size + len(text or "") > chunk_chars:
                    done = zip(*pair.align(chunk)) if chunk else [()] * 4
                    yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(done, (pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["n_a", "n_b", "groups", "links"])
                    chunk, size = [], 0
                chunk.append(text)
                size += len(text or "")
            del texts

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out_col.lower()], both(F.col(text_col)).alias(out_col))


def _code(a_path: str, b_path: str) -> tuple[int, str]:
    pair = tokenizers(a_path, b_path)
    return pair.b_count, pair.code.str


def link_bytes(a_path: str, b_path: str) -> int:
    """The bytes of a packed link."""
    return tokenizers(a_path, b_path).code.itemsize


def pair_counts(links: DataFrame, a_path: str, b_path: str, held_links: int = HELD_LINKS) -> DataFrame:
    """``a_id, b_id, n``: how many links hold each pair; ``links`` has one binary column."""

    def count(batches):
        b_count, code = _code(a_path, b_path)
        known, n, held, size = np.zeros(0, code), np.zeros(0, np.int64), [], 0

        def counted():
            pairs, where, more = np.unique(np.concatenate([known, *held]), return_inverse=True, return_counts=True)
            more = more.astype(np.int64)
            np.add.at(more, where[: len(known)], n - 1)
            return pairs, more

        for batch in batches:
            for packed in batch.column(0):
                own = np.frombuffer(packed.as_py() or b"", code)
                held.append(own)
                size += len(own)
                if size > held_links:
                    (known, n), held, size = counted(), [], 0
        known, n = counted()
        for low in range(0, len(known), 50_000):
            part = known[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array((part // b_count).astype(np.int64)), pa.array((part % b_count).astype(np.int64)), pa.array(n[low : low + 50_000])], ["a_id", "b_id", "n"])

    return links.mapInArrow(count, "a_id long, b_id long, n long").groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, counts: DataFrame, a_path: str, b_path: str, links_col: str = "links", row_col: str = "row", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose pair is the most frequent one of its B id,
    ties included) and ``count_sum`` (the counts of the links' pairs).

    ``row_col`` tells the rows of a written table apart; it is used where the pairs need more
    than one block."""
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    ranked = counts.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))
    blocks = max(1, -(-counts.count() // block_pairs))
    block = F.pmod(F.xxhash64("a_id", "b_id"), F.lit(blocks))

    def scored(n: int):
        table = ranked.filter(block == n).toArrow()
        a, b, count, best = (c.to_numpy() for c in table.columns)
        order = np.lexsort((b, a))
        shared = aligned.sparkSession.sparkContext.broadcast((a[order], b[order], count[order], best[order]))

        @F.arrow_udf("struct<n_best: bigint, count_sum: bigint>")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            b_count, code = _code(a_path, b_path)
            a, b, count, best = shared.value
            pairs = a.astype(np.uint64) * np.uint64(b_count) + b.astype(np.uint64)
            for packed in batches:
                n_best, sums = [], []
                for x in packed:
                    own = np.frombuffer(x.as_py() or b"", code).astype(np.uint64)
                    at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                    at = at[pairs[at] == own] if len(pairs) else at[:0]
                    n_best.append(int(best[at].sum()))
                    sums.append(int(count[at].sum()))
                yield pa.StructArray.from_arrays([pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())], ["n_best", "count_sum"])

        return score(F.col(links_col))

    rest = [c for c in aligned.columns if c not in ("n_best", "count_sum")]
    if blocks == 1:
        return aligned.select(*rest, scored(0).alias("scored_")).select(*rest, "scored_.*")
    parts = None
    for n in range(blocks):
        part = aligned.select(row_col, scored(n).alias("scored_")).select(row_col, "scored_.*")
        parts = part if parts is None else parts.union(part)
    sums = parts.groupBy(row_col).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.select(rest).join(sums, row_col)
