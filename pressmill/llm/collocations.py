"""Frequent word phrases and how strongly their words hold together, by SON partitioning.

1. Words are counted by language.  The corpus is cut into shards, the rows of one task
   each; a task that is given far more than its share cuts them again.
2. Each shard is mined completely at local support: a phrase of a shard with ``n_i`` of
   the language's ``n`` words needs ``min_count * n_i / n`` occurrences there, rounded
   up.  A phrase with ``min_count`` in all must reach that in some shard.  The miner goes
   up level by level: a phrase is looked at only where the phrases without its first
   and without its last word are frequent.
3. What is frequent in any shard is a candidate, and all candidates are counted over all
   texts, exactly.  They form tries of words; the tries are broadcast in blocks of
   bounded size, and every block is met with every text.
4. Parts of a phrase are frequent if the phrase is, so their counts are at hand; the
   score of a phrase is that of its weakest cut, in whole numbers of 38 digits.  A phrase
   that a longer one contains whenever it occurs is dropped.

There are about ``min_count / LOCAL_SUPPORT`` shards, so that the local support stays
above noise, unless that would make them larger than ``MAX_SHARD_WORDS``: many more
shards than ``min_count`` make every phrase a candidate, right but costly.  A corpus that
large wants larger shards (memory: about 15 bytes a word) or a larger ``min_count``.

Defined results: null texts have no words, a null language counts as ``und``.  Pieces
end at ``.,;:!?`` and line breaks, and no phrase crosses them; words are what stands
between spaces and tabs, with A-Z lowered.  Repeated rows count as often as they occur.
Overlapping occurrences all count.  Other columns are ignored."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _give_back, no_model, stored

MIN_COUNT, MAX_WORDS = 100, 5
LOCAL_SUPPORT = 16
MAX_SHARD_WORDS = 24_000_000
#: A task that gets far more than its share closes a shard at so many words or bytes of
#: different words, and begins another one.
TASK_WORDS, TASK_VOCABULARY = 2 * MAX_SHARD_WORDS, 400 << 20
#: Keys that are sorted at a time; bytes of phrases in a block of candidates.
ROUND, BLOCK_BYTES = 1 << 21, 24 << 20
UNKNOWN = "und"
BREAKS = ".,;:!?\n\x0b\x0c\r"
_BREAK = b"."  # stands for all of them, since no word has it
_TABLE = bytes(ord(_BREAK) if chr(b) in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: bytes, slice_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text and a mark for each break, slice by slice; a break ends it."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = len(text) if len(text) - at <= slice_bytes else text.find(b" ", at + slice_bytes)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(_BREAK, b" . ").split()
        at = end
    yield [_BREAK]


class _Ids(dict):
    """Numbers words as they come; a break is -1."""

    def __init__(self):
        super().__init__({_BREAK: -1})
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        self.size += len(word) + 130
        return n


def _slices(n: int, most: int = 1 << 20) -> Iterator[slice]:
    return (slice(low, min(low + most, n)) for low in range(0, n, most))


def _sizes(seq: np.ndarray, count: int) -> np.ndarray:
    """How often each number from 0 on occurs; -1 is left out."""
    out = np.zeros(count + 1, np.int64)
    for part in _slices(len(seq)):
        out += np.bincount(seq[part] + 1, minlength=count + 1)
    return out[1:]


def extended(now: np.ndarray, least: int, round_keys: int = ROUND) -> tuple[np.ndarray, np.ndarray]:
    """One level up: for each place a number for the pair of what stands there and next
    to it, or -1 if that pair occurs fewer than ``least`` times, and a place of each number.

    Pairs are sorted in rounds by their first number, so memory follows ``round_keys`` and
    4 bytes a place."""
    out, firsts, done = np.full(len(now), -1, np.int32), [], 0
    count = int(now.max()) + 1 if len(now) else 0
    # A place counts if something stands next to it, too.
    both = lambda part: np.where(now[part.start + 1 : part.stop + 1] >= 0, now[part], -1)
    n = np.zeros(count + 1, np.int64)
    for part in _slices(len(now) - 1):
        n += np.bincount(both(part) + 1, minlength=count + 1)
    ends, low = np.cumsum(n[1:]), 0
    while low < count:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + round_keys, "right")))
        if ends[high - 1] > before:
            at = np.concatenate([part.start + np.flatnonzero(((own := both(part)) >= low) & (own < high)) for part in _slices(len(now) - 1)])
            _, first, which, times = np.unique(now[at].astype(np.int64) << 32 | now[at + 1], return_index=True, return_inverse=True, return_counts=True)
            often = np.flatnonzero(times >= least)
            number = np.full(len(times), -1, np.int32)
            number[often] = np.arange(done, done + len(often))
            out[at] = number[which]
            firsts.append(at[first[often]])
            done += len(often)
        low = high
    return out, np.concatenate(firsts) if firsts else np.zeros(0, np.int64)


def frequent(words: np.ndarray, least: int, max_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length from 2 on, the place of one occurrence of each phrase that occurs
    ``least`` times in ``words`` (numbers of frequent words, -1 elsewhere)."""
    now = words
    for size in range(2, max_words + 1):
        now, first = extended(now, least)
        if not len(first):
            return
        yield size, first


class _Shard:
    """The words of one shard, by language."""

    def __init__(self):
        self.langs: dict[str, tuple[_Ids, array, int]] = {}
        self.words = 0

    def add(self, lang: str, total: int, text: bytes) -> None:
        if lang not in self.langs:
            self.langs[lang] = (_Ids(), array("i"), total)
        ids, own, _ = self.langs[lang]
        for part in tokens(text):
            own.extend(map(ids.__getitem__, part))
            self.words += len(part) - part.count(_BREAK)

    def full(self) -> bool:
        return self.words >= TASK_WORDS or sum(ids.size for ids, _, _ in self.langs.values()) >= TASK_VOCABULARY

    def mined(self, min_count: int, max_words: int) -> Iterator[tuple[str, list[str]]]:
        """Each language with its locally frequent phrases, and the words of these."""
        kept = {}
        for lang in list(self.langs):  # rare words go before anything is sorted
            ids, own, total = self.langs.pop(lang)
            seq = np.frombuffer(own, np.int32)
            times = _sizes(seq, len(ids) - 1)
            least = max(1, -(-min_count * int(times.sum()) // total))
            often = times >= least
            number = np.append(np.where(often, np.cumsum(often) - 1, -1), -1).astype(np.int32)  # the last is for -1
            for part in _slices(len(seq)):
                seq[part] = number[seq[part]]
            kept[lang] = ([w for w, stays in zip(list(ids)[1:], often.tolist()) if stays], own, least)
            del ids, seq
        _give_back()
        for lang in list(kept):
            words, own, least = kept.pop(lang)
            seq = np.frombuffer(own, np.int32)
            for size, places in frequent(seq, least, max_words):
                for low in range(0, len(places), 10_000):
                    some = seq[places[low : low + 10_000, None] + np.arange(size)]
                    yield lang, [b" ".join([words[w] for w in row]).decode() for row in some.tolist()]
                if size == 2:
                    alone = np.unique(seq[places[:, None] + np.arange(2)])
                    yield lang, [words[w].decode() for w in alone.tolist()]
            del own, words, seq


def _phrases(lang: str, phrases: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string())], ["lang", "phrase"])


class Trie:
    """Candidates of one language as a trie of words.

    Nodes are first the words and then the longer phrases; an edge is a node with a word,
    its key ``node * words + word``.  What a candidate begins with must be one, too."""

    def __init__(self, phrases: list[str]):
        own = sorted((p.split(" ") for p in phrases), key=len)
        self.words: dict[bytes, int] = {}
        for p in own:
            for w in p:
                self.words.setdefault(w.encode(), len(self.words))
        n = len(self.words)
        nodes: dict[tuple[int, int], int] = {}
        self.names: list[str | None] = [None] * n  # of words that are only parts
        for p in own:
            at = -1
            for w in p:
                word = self.words[w.encode()]
                at = word if at < 0 else nodes.setdefault((at, word), n + len(nodes))
                if at == len(self.names):
                    self.names.append(None)
            self.names[at] = " ".join(p)
        keys = np.array([node * n + word for node, word in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.depth = len(own[-1]) if own else 0

    def count(self, seq: np.ndarray, counts: np.ndarray) -> None:
        """Add the occurrences of each node in ``seq`` (numbers of words, -1 elsewhere)."""
        at = np.flatnonzero(seq >= 0)
        node = seq[at].astype(np.int64)
        counts += np.bincount(node, minlength=len(counts))
        for step in range(1, self.depth):
            inside = at + step < len(seq)
            at, node = at[inside], node[inside]
            word = seq[at + step]
            known = word >= 0
            at, key = at[known], node[known] * len(self.words) + word[known]
            place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
            at, node = at[hit], self.targets[place[hit]]
            counts += np.bincount(node, minlength=len(counts))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND text <> ''")


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, n``: how many words the texts of each language have."""
    n = F.regexp_count("text", F.lit("[^\\x20\\x09.,;:!?\\x0A-\\x0D]+")).cast("long")
    return _texts(docs, text_col, lang_col).groupBy("lang").agg(F.sum(n).alias("n"))


def shards_for(totals: DataFrame, min_count: int) -> int:
    words = totals.agg(F.sum("n")).first()[0] or 0
    return max(1, min_count // LOCAL_SUPPORT, -(-words // MAX_SHARD_WORDS))


def candidates(docs: DataFrame, totals: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang", shards: int | None = None) -> DataFrame:
    """``lang, phrase``: what is frequent in some shard, and the words of it."""

    def mine(batches):
        no_model()
        shard = _Shard()
        for batch in batches:
            for at in range(batch.num_rows):
                lang, text, total = (c[at].as_py() for c in batch.columns)
                shard.add(lang, total, text)
                if shard.full():
                    yield from (_phrases(*found) for found in shard.mined(min_count, max_words))
                    shard = _Shard()
        yield from (_phrases(*found) for found in shard.mined(min_count, max_words))

    shards = shards or shards_for(totals, min_count)
    # A language with fewer words than min_count has no candidates.
    texts = _texts(docs, text_col, lang_col).join(totals.filter(F.col("n") >= min_count), "lang").select("lang", F.col("text").cast("binary").alias("text"), "n")
    return texts.coalesce(shards).mapInArrow(mine, "lang string, phrase string").distinct()


def _counted(texts: DataFrame, tries: dict[str, Trie]) -> DataFrame:
    """``lang, phrase, f``: occurrences in parts of the texts, for the candidates of one block."""
    shared = texts.sparkSession.sparkContext.broadcast(tries)

    def count(batches):
        no_model()
        own = shared.value
        sums = {lang: np.zeros(len(t.names), np.int64) for lang, t in own.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                seqs: dict[str, array] = {}
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if lang in own:
                        get, seq = own[lang].words.get, seqs.setdefault(lang, array("i"))
                        for part in tokens(text):
                            seq.extend(map(get, part, repeat(-1)))
                for lang, seq in seqs.items():
                    own[lang].count(np.frombuffer(seq, np.int32), sums[lang])
        for lang, n in sums.items():
            names = own[lang].names
            there = [i for i in np.flatnonzero(n).tolist() if names[i] is not None]
            for low in range(0, len(there), 10_000):
                some = there[low : low + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([names[i] for i in some], pa.string()), pa.array(n[some])], ["lang", "phrase", "f"])

    return texts.mapInArrow(count, "lang string, phrase string, f long")


def counts(docs: DataFrame, found: DataFrame, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang", shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``lang, phrase, f``: exact counts of the candidates ``found`` that reach ``min_count``.

    A block has whole groups of candidates with one first word, so each has what its
    members begin with.  A task counts one shard, so that a candidate is a row a shard."""
    size = found.agg(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    texts = _texts(docs, text_col, lang_col).select("lang", F.col("text").cast("binary").alias("text"))
    texts = texts.coalesce(shards) if shards else texts
    out = found.select("lang", "phrase", F.lit(0).cast("long").alias("f")).limit(0)
    block = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 1)), F.lit(max(blocks, 1)))
    for n in range(blocks):
        by: dict[str, list[str]] = {}
        for lang, phrase in zip(*(c.to_pylist() for c in found.filter(block == n).select("lang", "phrase").toArrow().columns)):
            by.setdefault(lang, []).append(phrase)
        out = out.union(_counted(texts, {lang: Trie(phrases) for lang, phrases in by.items()}))
    return out.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang", shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of every phrase of 2 to ``max_words`` words that
    occurs ``min_count`` times in its language and not always inside the same longer one.

    ``score`` is ``1000 * a * n / (l * r)``, rounded down, of the cut into a first part
    (``l`` occurrences) and a rest (``r``) where that is least; the first of such cuts."""
    totals = stored(word_counts(docs, text_col, lang_col))
    shards = shards or shards_for(totals, min_count)
    found = stored(candidates(docs, totals, min_count, max_words, text_col, lang_col, shards))
    often = stored(counts(docs, found, min_count, text_col, lang_col, shards, block_bytes))
    phrases = often.select("lang", F.col("f").alias("a"), "phrase", F.split("phrase", " ").alias("words")).filter(F.size("words") > 1)
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(often.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(often.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(totals, "lang").withColumn("over", whole("a") * 1000 * whole("n")).withColumn("under", whole("l") * whole("r"))
    best = F.min(F.struct(F.expr("over DIV under").alias("score"), "k", "l", "r", "n")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a").agg(best)
    # A phrase that is always inside a longer one is always inside one of one word more.
    longer = phrases.filter(F.size("words") > 2)
    inner = longer.select("lang", F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("a"))
    alone = scored.join(inner, ["lang", "phrase", "a"], "left_anti")
    return alone.select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def top(phrases: DataFrame, k: int) -> DataFrame:
    """The first ``k`` phrases of each language with their ``rank``: by score and count,
    highest first, then by phrase.  Each language is thinned in 64 parts before its
    phrases meet."""
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*by))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= k)
