"""Language identification by partial matching.

A context tree of bytes holds, for each language, what follows every context of up
to ``order`` bytes, with counts.  A byte that a language has not seen in a context
costs an escape (method C: the number of different followers over that number plus
the total) and is coded in the next shorter context; below the empty context all
256 bytes are equally likely.  The counts are frozen after fitting, so the code
length of a text under a language is a sum over its bytes, and the language with
the shortest code wins.

Only byte strings that occur are held: ``GROUP_LANGS`` languages share a tree, in
which a string has a row of costs, so memory follows what was learnt, and neither
the number of languages nor their scripts multiply it.

Fitting reads a bounded sample of labelled rows, chosen by a hash of id and text,
whole texts: about ``rows_per_lang`` rows a language and ``SAMPLE_BYTES`` in all, dealt
equally, as expected values, and one row of every language at least.  All counts of the
sample are used.  Scoring reads every byte.

Defined results: null text or text without a letter gives ``und`` and score 0;
so does every row if there is nothing to learn from.  Rows whose language is
null are not learnt from.  Repeated rows get equal results.  Equal code lengths
go to the language that sorts first.  An input column with the name of the result
(``out_col``) is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, no_model, resident

ORDER = 3
ROWS_PER_LANG = 300
#: Expected bytes of all learnt texts together; the counts that reach the driver follow them.
SAMPLE_BYTES = 16 << 20
GROUP_LANGS = 8
#: Bytes of evidence that a score takes as independent; more text doesn't raise it.
EVIDENCE = 48
WINDOW = 1 << 16
UNKNOWN = "und"


@dataclass
class Counts:
    """What a fit learns: counts of byte strings of 1 to ``order`` + 1 bytes."""

    langs: list[str]
    order: int
    lang: np.ndarray
    length: np.ndarray
    gram: np.ndarray
    count: np.ndarray


def _grams(values: np.ndarray, offsets: np.ndarray, order: int):
    """Counts of the packed byte strings of each length, none across texts."""
    x = values.astype(np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(x))  # bytes to the end of the text
    packed = np.zeros(len(x), np.int64)
    for n in range(1, order + 2):
        if len(x) < n:
            return
        packed = (packed[: len(x) - n + 1] << 8) | x[n - 1 :]
        yield n, *np.unique(packed[left[: len(packed)] >= n], return_counts=True)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column as one array, and where each value starts."""
    wide = column.type == pa.large_binary()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8), at - at[0]


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, rows_per_lang: int = ROWS_PER_LANG, sample_bytes: int = SAMPLE_BYTES) -> Counts:
    """Learn from ``rows``; the counts come to the driver, bounded by the sample."""
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("draw"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    seen = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.min("draw").alias("least")).collect()
    seen.sort(key=lambda r: r["lang"])  # a row a language, as in the model
    langs = [r["lang"] for r in seen]
    if not langs:
        return Counts([], order, *(np.zeros(0, np.int64) for _ in range(4)))
    scale = 1 << 30
    share = lambda r: min(1.0, rows_per_lang / r["rows"], sample_bytes / len(langs) / max(r["bytes"], 1))
    chosen = rows.sparkSession.createDataFrame([(i, r["lang"], r["least"], int(share(r) * scale) + 1) for i, r in enumerate(seen)], "number int, s_lang string, least long, limit long")
    if sum(len(x) + 64 for x in langs) <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    sample = rows.join(chosen, F.col("lang") == F.col("s_lang")).filter((F.pmod("draw", F.lit(scale)) < F.col("limit")) | (F.col("draw") == F.col("least")))

    def count(batches):
        no_model()
        for batch in batches:
            langs_of = batch.column(0).to_numpy()
            for lang in np.unique(langs_of):
                values, offsets = _binary(batch.column(1).filter(pa.array(langs_of == lang)))
                for n, gram, times in _grams(values, offsets, order):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, np.int32)), pa.array(np.full(len(gram), n, np.int32)), pa.array(gram), pa.array(times.astype(np.int64))], ["lang", "n", "gram", "cnt"])

    counted = (
        sample.select("number", F.encode("text", "UTF-8").alias("bytes"))
        .mapInArrow(count, "lang int, n int, gram long, cnt long")
        .groupBy("lang", "n", "gram").agg(F.sum("cnt").alias("cnt"))
        .toArrow()
    )
    return Counts(langs, order, *(counted.column(c).to_numpy().astype(np.int64) for c in ("lang", "n", "gram", "cnt")))


class Tree:
    """The costs in bits of all byte strings that any of a few languages has seen.

    ``rows`` has a row for each string, a cost a language: that of its last byte after
    the others, with the escapes on the way if the language hasn't seen it there.
    ``escapes`` has what a language pays where a context has another follower.  Strings
    are found by open addressing in a table that is at most half full."""

    def __init__(self, counts: Counts):
        self.order, self.langs = counts.order, len(counts.langs)
        levels = [np.unique(counts.gram[counts.length == n]) for n in range(1, self.order + 2)]
        first = np.cumsum([0, *map(len, levels)])
        at = lambda n, gram: first[n - 1] + np.searchsorted(levels[n - 1], gram)
        rows, escapes = np.zeros((2, first[-1], self.langs), np.float32)
        self.root = np.zeros(self.langs, np.float32)
        for n in range(1, self.order + 2):
            gram, own = levels[n - 1], counts.length == n
            place, lang, times = np.searchsorted(gram, counts.gram[own]), counts.lang[own], counts.count[own].astype(float)
            parent = at(n - 1, counts.gram[own] >> 8) - first[max(n - 2, 0)] if n > 1 else np.zeros(len(lang), np.int64)
            total, kinds = np.zeros((2, len(levels[n - 2]) if n > 1 else 1, self.langs))
            np.add.at(total, (parent, lang), times)
            np.add.at(kinds, (parent, lang), 1)
            some = kinds > 0
            escape = np.where(some, -np.log2(np.where(some, kinds, 1) / np.where(some, total + kinds, 1)), 0)
            if n == 1:
                self.root = escape[0].astype(np.float32)
                cost = np.full((len(gram), self.langs), 8.0) + escape
            else:
                context = at(n - 1, gram >> 8)
                escapes[first[n - 2] : first[n - 1]] = escape
                cost = rows[at(n - 1, gram & ((1 << 8 * (n - 1)) - 1))] + escapes[context]
            cost[place, lang] = -np.log2(times / (total + kinds)[parent, lang])
            rows[first[n - 1] : first[n]] = cost
        self.rows, self.escapes = rows, escapes
        keys = np.concatenate([g | (1 << 8 * n) for n, g in enumerate(levels, 1)])
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32)
        new, slot = np.arange(len(keys)), self._slot(keys)
        while len(new):  # of the strings that want a free place the first gets it
            _, winner = np.unique(slot, return_index=True)
            winner = winner[self.ids[slot[winner]] < 0]
            self.ids[slot[winner]], self.keys[slot[winner]] = new[winner], keys[new[winner]]
            rest = np.ones(len(new), bool)
            rest[winner] = False
            new, slot = new[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of strings (packed, with their length), -1 for others."""
        slot = self._slot(keys)
        out = self.ids[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.ids[slot[todo]]
            todo = todo[(self.keys[slot[todo]] != keys[todo]) & (out[todo] >= 0)]
        return out

    def lengths(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language.

        The bytes are taken in windows with ``order`` bytes before each of them,
        which is all that a frozen tree needs to go on exactly."""
        bits = np.zeros((len(offsets) - 1, self.langs))
        for at in range(0, len(values), WINDOW):
            low, end = max(0, at - self.order), min(len(values), at + WINDOW)
            x = values[low:end].astype(np.int64)
            doc = np.searchsorted(offsets, np.arange(low, end), "right") - 1
            since = np.arange(low, end) - np.maximum(offsets[doc], low)  # bytes of the text before, in this window
            each = np.zeros((len(x), self.langs), np.float32)
            packed, found = np.zeros(len(x), np.int64), []
            for n in range(1, self.order + 2):  # strings that end at each byte
                packed = packed | np.concatenate([np.zeros(n - 1, np.int64), x[: max(len(x) - n + 1, 0)] << 8 * (n - 1)])[: len(x)]
                ids = self._find(packed | (1 << 8 * n))
                ids[since < n - 1] = -1
                found.append(ids)
            todo = np.arange(len(x))
            for k in range(self.order, 0, -1):
                context = np.where(todo > 0, found[k - 1][todo - 1], -1)
                context[since[todo] < k] = -1
                seen = found[k][todo]
                hit = (context >= 0) & (seen >= 0)
                each[todo[hit]] += self.rows[seen[hit]]
                missed = (context >= 0) & (seen < 0)
                each[todo[missed]] += self.escapes[context[missed]]
                todo = todo[~hit]
            seen = found[0][todo]
            each[todo[seen >= 0]] += self.rows[seen[seen >= 0]]
            each[todo[seen < 0]] += self.root + 8
            each = each[at - low :]
            doc, last = doc[at - low], doc[-1]
            cuts = np.maximum(offsets[doc : last + 1], at) - at
            some = np.flatnonzero(np.diff(np.append(cuts, end - at)) > 0)
            bits[doc + some] += np.add.reduceat(each, cuts[some], axis=0, dtype=np.float64)
        return bits


class Forest:
    """Trees of a few languages each; a language's code length needs its own counts only."""

    def __init__(self, counts: Counts):
        self.trees = []
        for i in range(0, len(counts.langs), GROUP_LANGS):
            own = (counts.lang >= i) & (counts.lang < i + GROUP_LANGS)
            self.trees.append(Tree(Counts(counts.langs[i : i + GROUP_LANGS], counts.order, counts.lang[own] - i, counts.length[own], counts.gram[own], counts.count[own])))

    def lengths(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.concatenate([t.lengths(values, offsets) for t in self.trees], axis=1)


def predictor(spark, counts: Counts):
    """A function from a text column to ``struct(lang_pred, score, bits_per_byte)``."""
    if not counts.langs:
        return lambda text: F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = spark.sparkContext.broadcast(counts)
    names = np.array(counts.langs, object)

    @F.arrow_udf("struct<lang_pred string, score double, bits_per_byte double>")
    def score(texts: pa.Array) -> pa.Array:
        forest = resident(("forest", shared._path), lambda: Forest(shared.value))
        values, offsets = _binary(texts)
        size = np.maximum(np.diff(offsets), 1)[:, None]
        rate = forest.lengths(values, offsets) / size
        best = rate.argmin(axis=1)
        lead = rate - rate[np.arange(len(best)), best][:, None]
        sure = 1 / np.exp2(-lead * np.minimum(size, EVIDENCE)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(sure), pa.array(rate[np.arange(len(best)), best])], ["lang_pred", "score", "bits_per_byte"])

    def predict(text: Column) -> Column:
        lettered = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
        got = score(F.encode(F.when(lettered, text).otherwise(F.lit("")), "UTF-8"))
        unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
        return F.when(lettered, got).otherwise(unknown)

    return predict


def identify(docs: DataFrame, counts: Counts, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out_col``; whole texts, no shuffle."""
    return docs.withColumn(out_col, predictor(docs.sparkSession, counts)(F.col(text_col)))
