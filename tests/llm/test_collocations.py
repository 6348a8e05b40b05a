import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pressmill.llm import collocations, queries
from tests.test_oracles import _rows

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, most=5):
    """Counts every phrase by language; all longer phrases are looked at."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    held = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = {}
    for (lang, p), a in held.items():
        if any(o[0] == lang and len(o[1]) > len(p) and 100 * c >= 100 * a and inside(p, o[1]) for o, c in held.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    return out


def mined(df, **options):
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.mine(df, **options).collect()}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Ä", "ÉÉ", "a b", "x\x00y", "#"]
    rows = []
    for i in range(150):
        own = rng.choices(words, [2 ** -(k % 6) for k in range(len(words))], k=rng.randint(0, 40))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", " ! ", "\x0b"]) for w in own) + rng.choice(["", "the very long end of it"])))
    return rows + [("en", None), ("en", ""), ("en", " \n.. "), (None, "Only Once"), ("fr", "z " * 30), ("fr", "z " * 30), ("es", "A a A a")]


@pytest.mark.parametrize("shards,least,block", [(1, 5, 1 << 20), (7, 5, 300), (3, 20, 2000), (40, 2, 1 << 20)])
def test_equals_brute_force(spark, shards, least, block):
    rows = corpus()
    df = spark.createDataFrame([(i % 5, lang, text, 1, "x") for i, (lang, text) in enumerate(rows)], "doc_id int, lang string, text string, phrase int, n string").repartition(8)
    want = plain(rows, least)
    assert want and mined(df, min_count=least, shards=shards, block_bytes=block) == want


def test_small_rounds_and_shards(monkeypatch):
    seq = np.random.default_rng(3).integers(-1, 9, 4000).astype(np.int32)
    pairs = list(zip(seq[:-1].tolist(), seq[1:].tolist()))
    n = Counter(pairs)
    often = lambda p: min(p) >= 0 and n[p] >= 45
    for size in (1 << 22, 100, 1):
        number, first = collocations.extended(seq, 45, size)
        assert [x >= 0 for x in number] == [often(p) for p in pairs] + [False]
        assert len({(p, x) for p, x in zip(pairs, number.tolist()) if x >= 0}) == len(first) == sum(map(often, n))
        assert all(number[at] == i for i, at in enumerate(first.tolist()))
    shard = collocations._Shard()
    shard.add("en", 10, b"a b a b a b. a")
    assert shard.words == 7 and not shard.full()
    monkeypatch.setattr(collocations, "TASK_WORDS", 7)
    assert shard.full() and [p for _, ps in shard.mined(3, 3) for p in ps] == ["a b", "a", "b"]


def test_every_slice_gives_the_same_words():
    text = "One two. three\tfour\n FIVE six,seven  Éa " * 20
    whole = [w for part in collocations.tokens(text.encode()) for w in part]
    for size in (1, 3, 10, 100):
        assert [w for part in collocations.tokens(text.encode(), size) for w in part] == whole


def test_empty_tables_ties_and_ranks(spark):
    df = spark.createDataFrame(corpus(), "lang string, text string")
    assert mined(df.limit(0), min_count=2) == {} and mined(df.filter("text IS NULL"), min_count=2) == {}
    found = plain(corpus(), 3)
    for k in (1, 5, 10_000):
        got = {(r["lang"], r["rank"]): r["phrase"] for r in collocations.top(collocations.mine(df, min_count=3), k).collect()}
        want = {}
        for lang in {p[0] for p in found}:
            own = sorted((x for x in found.items() if x[0][0] == lang), key=lambda x: (-x[1][4], -x[1][0], x[0][1].encode()))
            want |= {(lang, i): x[0][1] for i, x in enumerate(own[:k], 1)}
        assert got == want


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'" if os.path.isfile(f"{SF}/documents.parquet") else f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet/*.parquet'")
    ours, theirs = queries.QUERIES["op12_son_collocations"](spark, SF).toPandas(), con.sql(queries.ORACLE["op12_son_collocations"]).df()
    assert len(ours) and _rows(ours) == _rows(theirs)
    assert set(ours.dtypes[["rank", "a", "l", "r", "n", "score"]].astype(str)) == {"int64"}
