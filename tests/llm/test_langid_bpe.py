import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.llm import bpe, langid, queries
from pressmill.llm.stages import tokenizer_file

TEXTS = ["the cat sat on the mat and the rat", "le chat est sur le tapis avec le rat", "the dog and the cat", "le chien et le chat", None, "", "123 !!", "x" * 5000 + " the"]
SCHEMA = "doc_id long, text string, lang string, extra int"


def plain_bits(counts, lang, text: bytes) -> float:
    """Code length by walking down from the longest context, one byte at a time."""
    table = {}
    for g_lang, n, gram, c in zip(counts.lang, counts.length, counts.gram, counts.count):
        raw = int(gram).to_bytes(int(n), "big")
        table.setdefault((int(g_lang), raw[:-1]), {})[raw[-1]] = int(c)
    bits = 0.0
    for i, b in enumerate(text):
        for k in range(min(i, counts.order), -1, -1):
            seen = table.get((lang, text[i - k : i]))
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if b in seen:
                bits -= math.log2(seen[b] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_match_a_plain_coder(spark):
    rows = [(i, t, "en" if "the" in (t or "") else "fr", i) for i, t in enumerate(TEXTS * 3)]
    counts = langid.fit(spark.createDataFrame(rows, SCHEMA))
    tree = langid.Forest(counts)
    given = [t.encode() for t in TEXTS if t is not None] + ["été — ñ".encode()]
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in given])])
    whole = np.frombuffer(b"".join(given), np.uint8)
    want = np.array([[plain_bits(counts, k, g) for k in range(len(counts.langs))] for g in given])
    for window in (langid.WINDOW, 7, 1):  # the windows must not matter
        langid.WINDOW, kept = window, langid.WINDOW
        try:
            np.testing.assert_allclose(tree.lengths(whole, offsets), want, rtol=1e-4, atol=1e-3)
        finally:
            langid.WINDOW = kept


def test_undetermined_and_empty(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r["language"] for r in langid.identify(df, langid.fit(df)).collect()}
    assert [out[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and out[4]["score"] == 0
    assert out[0]["lang_pred"] == "en" and 0 < out[0]["score"] <= 1
    nothing = langid.fit(df.limit(0))
    assert {r["language"]["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), langid.fit(df)).count() == 0


def test_held_out_accuracy(spark):
    out = queries.op3_ppm_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


ODD = ["", "a", "Hello world, it's  fine!\n\n  ok\t", "<|endoftext|>x<|endoftext|>", "été naïve 日本語 🙂 \u00a0\u2003z", "x" * 3000, "don't we'll I'm", "  \n \r\n  ", "0123456789 3.14", "Ünïcödé " * 50, "a\u0300 e\u0301", "<|endoftext", "\x00\x01\x85\x1c ", "ſ ẞ İ"]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file())
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = ODD + docs
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    ids = rows.select("doc_id", bpe.encoded(F.col("text"), tokenizer_file()).alias("ids"))
    got = {r["doc_id"]: r for r in ids.withColumn("back", bpe.decoded(F.col("ids"), tokenizer_file())).collect()}
    for i, t in enumerate([*texts, ""]):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want, t[:60]
        assert got[i]["back"] == lib.decode(want, skip_special_tokens=False), t[:60]


def test_bpe_trie_shares_prefixes_and_cache_is_bounded():
    vocab = bpe.Vocabulary(tokenizer_file())
    words = ["walk", "walking", "walked", " walkway", "w", "aaaaaaa", "ananananan"]
    out = vocab.encode_words(words)
    assert all(np.frombuffer(out[w], "<u4").tolist() == vocab.merged(w.encode()) for w in words)
    nodes = len(vocab.node_last)
    vocab.encode_words(["walk", "walker"])
    assert len(vocab.node_last) == nodes + 1  # only the last letter is new
    kept, bpe.CACHE_WORDS = bpe.CACHE_WORDS, 3
    try:
        for t in ("one two three four", "five six seven eight nine", "one"):
            assert vocab.decode(np.frombuffer(vocab.encode([t])[0], "<u4")) == t
        assert len(vocab.cache) <= 3 + 1
    finally:
        bpe.CACHE_WORDS = kept


def test_op6_columns(spark):
    r = queries.op6_trie_bpe(spark, "/root/testdata/sf0.001").limit(1).first()
    assert len(r["ids_sha256"]) == 64 and r["n_tokens"] > 0
    assert hashlib.sha256(b"").hexdigest() != r["ids_sha256"]


@pytest.mark.parametrize("text", ["a b c d", "zz", "é"])
def test_neighbours_agree_with_merging(text):
    vocab = bpe.vocabulary(tokenizer_file())
    ids = vocab.merged(text.encode())
    assert all(vocab.neighbours(a, b) for a, b in zip([-1, *ids], ids))


def test_very_long_words_equal_the_library_in_bounded_space():
    import random

    from tokenizers import Tokenizer

    lib, vocab, draw = Tokenizer.from_file(tokenizer_file()), bpe.vocabulary(tokenizer_file()), random.Random(5)
    nodes = len(vocab.node_last)
    for word in ("x" * 200_000, "".join(draw.choice("abcdehilnorst") for _ in range(150_000)), "日本語" * 30_000, "é" * 70_001, "the" * 2_000, "=" * 100_000):
        ids = np.frombuffer(vocab.encode([word])[0], "<u4")
        assert ids.tolist() == lib.encode(word, add_special_tokens=False).ids and vocab.decode(ids) == word
    assert len(vocab.node_last) == nodes


def test_many_languages(spark):
    """More languages than a tree holds; each is told by its own letters."""
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 300) + j % 40) * 3 for j in range(30)), f"l{i % 300:03}", 0) for i in range(600)]
    df = spark.createDataFrame([*rows, (900, "x" * 10, None, 0), (901, None, "null text only", 0)], SCHEMA)
    counts = langid.fit(df)
    assert len(counts.langs) == 300 and len(langid.Forest(counts).trees) == -(-300 // langid.GROUP_LANGS)
    got = {r["doc_id"]: r["language"]["lang_pred"] for r in langid.identify(df, counts).collect()}
    assert sum(got[i] == f"l{i % 300:03}" for i in range(600)) >= 590
    small = langid.fit(df, sample_bytes=3000)
    assert set(small.lang.tolist()) == set(range(300))  # a text of every language at least
    replaced = langid.identify(df.withColumnRenamed("extra", "language"), counts)
    assert replaced.columns == ["doc_id", "text", "lang", "language"] and replaced.schema["language"].dataType.typeName() == "struct"
