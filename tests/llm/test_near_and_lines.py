import re

import numpy as np
from pyspark.sql import functions as F

from pressmill.llm import common, jaccard, linedup, queries

SCHEMA = "doc_id long, text string, extra int"


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Links and classes by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * u:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for i in range(len(rows)):
        ids.setdefault(find(i), []).append(rows[i][0])
    return [(min((x for x in ids[find(i)] if x is not None), default=None), links[i]) for i in range(len(rows))]


def test_jaccard_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similar(docs).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


def test_jaccard_blocks_and_edge_cases(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(100 + k, " ".join(base[:30] + [f"v{k}"] + base[30:]), k) for k in range(40)]  # near copies, all different
    rows += [(1, None, 0), (2, "", 0), (3, "!!! ...", 0), (4, "one two", 0), (5, "One, TWO", 0), (5, "One, TWO", 0), (6, "long " * 3000, 0), (7, " ".join(base), 0), (7, "other words that share an id only with it", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(zip([r[0] for r in rows], *zip(*brute([(r[0], r[1]) for r in rows]))))
    want = sorted((i, i if not shingles(t) else c, n) for (i, t, _), (c, n) in zip(rows, brute([(r[0], r[1]) for r in rows])))
    for options in ({}, {"block": 7}, {"block_bytes": 900}):  # with small blocks, buckets are cheaper than components
        got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.similar(df, **options).collect())
        assert got == want
    assert jaccard.similar(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f", 0), (None, "a b c d e f", 0)], SCHEMA)
    assert [(r["class_id"], r["n_links"]) for r in jaccard.similar(nulls).collect()] == [(None, 1)] * 2


def test_a_chain_is_verified_by_bucket(spark):
    """Each text shares a few buckets with the next one only, so the component is long."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 100])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for options in ({"block": 2}, {}):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similar(df, **options).collect()}
        assert [got[i] for i, _ in rows] == want
    monkey = spark.createDataFrame([(None, "a b c d e f"), (None, "g h i j k l m n"), (None, "a b c d e f"), (1, None)], "doc_id long, text string")
    assert sorted(r["n_links"] for r in jaccard.similar(monkey).collect()) == [0, 0, 1, 1]


def test_band_choice_reaches_recall():
    b, r = jaccard.choose_bands(0.8, 0.999, 320)
    assert b * r <= 320 and 1 - (1 - 0.8**r) ** b >= 0.999


def test_links_by_table_and_by_pair_agree():
    rng = np.random.default_rng(1)
    core = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core, rng.integers(1000, 9000, n).astype(np.uint64)])) for n in rng.integers(0, 40, 50)]
    all_same = np.ones((50, 2), np.int64)  # every pair is a candidate: the table is used
    left = np.arange(50)
    got = set(zip(*map(list, jaccard._links(sets, all_same, left, left, 0.8))))
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert {(int(a), int(b)) for a, b in got} == want
    some = rng.integers(0, 3, (50, 4)) + 10 * np.arange(4)  # buckets of four bands: each pair is met once
    met = [(int(a), int(b)) for bucket in np.unique(some) for a, b in zip(*jaccard._links(sets, some, left, left, 0.8, bucket))]
    assert len(met) == len(set(met)) and set(met) == {(i, j) for i, j in want if (some[i] == some[j]).any()}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (5, 5)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10} | {i: 100 for i in range(100, 161)}
    assert common.connected_components(edges.limit(0)).count() == 0


def test_patience():
    a, b = list("xabcyd"), list("abczd")
    assert linedup.patience(a, b) == [(1, 0), (2, 1), (3, 2), (5, 4)]
    assert linedup.patience(list("aa"), list("a")) == [(0, 0)]
    assert linedup.patience([], list("a")) == []
    assert linedup.patience(list("abc"), list("cab")) == [(0, 1), (1, 2)]
    assert linedup.blocks(list("xabcyd"), list("abczd"), [1, 2, 2, 2, 1, 1], 5) == [1, 2, 3]


def plain_dedup(rows, least=5):
    """For each (id, text): the lines that go, by comparing it with every earlier text.

    A line that isn't blank goes if it is in a run of lines with ``least`` words or more
    that an earlier text has too; a text equal to an earlier one loses all lines."""
    keys = [[x.strip() for x in t.split("\n")] if t else [] for _, t in rows]
    words = lambda x: len(re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]+|[^\s\u3040-\u30ff\u4e00-\u9fff]+", x)) if not re.search(r"[\u3040-\u30ff\u4e00-\u9fff]", x) else len(re.sub(r"[\u3040-\u30ff\u4e00-\u9fff]+", " ", x).split()) + -(-len(re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]", x)) // 2)
    order, first = sorted((i for i in range(len(rows)) if keys[i]), key=lambda i: rows[i][0]), {}
    gone = [set() for _ in rows]
    seen = []
    for i in order:
        key = tuple(keys[i])
        if key in first:
            gone[i] = set(range(len(key))) if rows[i][0] != rows[first[key]][0] else None
            continue
        first[key] = i
        where = {}
        for n, x in enumerate(key):
            where.setdefault(x, []).append(n)
        for other in seen:
            for m, x in enumerate(other):
                for n in where.get(x, ()):
                    if m and n and other[m - 1] == key[n - 1]:
                        continue  # not where a common run begins
                    k = 0
                    while n + k < len(key) and m + k < len(other) and key[n + k] == other[m + k]:
                        k += 1
                    if sum(map(words, key[n : n + k])) >= least:
                        gone[i] |= {p for p in range(n, n + k) if key[p]}
        seen.append(key)
    return [gone[first[tuple(k)]] if g is None else g for g, k in zip(gone, keys)]


def lines_left(rows, gone):
    return sorted(((i, [x for n, x in enumerate(t.split("\n")) if x.strip() and n not in g] if t else []) for (i, t), g in zip(rows, gone)), key=str)


def test_line_dedup_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("id"), F.lit(2).alias("cut"))
    extra = [(9001, None), (9002, ""), (9003, "\n\n"), (9004, "one two three four five six seven\nshort"), (9005, "short\none two three four five six seven \nnew line here"), (9005, "short\none two three four five six seven \nnew line here")]
    extra += [(9006, "alpha beta gamma one two three four"), (9007, "delta epsilon\nzeta"), (9008, "u\ndelta epsilon\nzeta eta theta\nv"), (9009, "w\ndelta epsilon\nzeta eta theta\nx"), (9010, "zeta eta theta\nq"), (9011, "a\n这是一个很长的中文段落没有空格\nb"), (9012, "c\n这是一个很长的中文段落没有空格\nd"), (9013, "e\n短的中文\nf"), (9014, "g\n短的中文\nh")]
    df = docs.union(spark.createDataFrame([(i, t, 1, 2) for i, t in extra], docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = linedup.deduplicate(df)
    got = [(r["doc_id"], r["deduped"]["text"]) for r in out.collect()]
    assert lines_left(got, [()] * len(got)) == lines_left(rows, plain_dedup(rows))
    left = dict(got)
    assert left[9005] == "short\nnew line here" and left[9009] == "w\nx" and left[9012] == "c\nd" and left[9014] == "g\n短的中文\nh" and left[9001] is None and left[9003] == "\n\n"
    assert linedup.deduplicate(df.limit(0)).count() == 0
    assert linedup.deduplicate(df.withColumnRenamed("id", "deduped")).columns == ["doc_id", "text", "cut", "deduped"]


def test_white_space_of_lines(spark):
    """Line ends of another kind, tabs and indentation: as str.strip() and str.split() have it."""
    passage = "one two three four five\nsix seven eight nine ten"
    rows = [
        (1, f"unix\n{passage}\nend"), (2, "dos\r\n" + passage.replace("\n", "\r\n") + "\r\nstays\r"), (3, "tabs\n\t" + passage.replace("\n", "\t\n\u00a0\t") + "\u2003\nthree"),
        (4, "a\n\t\n\t\n\t\nb"), (5, "c\n\t\n\t\n\t\nd"), (6, "e\n  one\n  two\n  three\nf"), (7, "g\n\tone\n\ttwo\n\tthree\nh"), (8, "i\n \u3000 \n\x1f\n\x85\nj"), (9, "k\n \u3000 \n\x1f\n\x85\nl"),
    ]
    got = [(r["doc_id"], r["deduped"]["text"]) for r in linedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert lines_left(got, [()] * len(got)) == lines_left(rows, plain_dedup(rows))
    left = dict(got)
    assert left[2] == "dos\r\nstays\r" and left[3] == "tabs\nthree"
    assert all(left[i] == t for i, t in rows if i not in (2, 3))


def test_hot_runs_by_broadcast_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(linedup.deduplicate(docs).select("doc_id", "deduped.text").collect())
    monkeypatch.setattr(linedup, "HOT_TEXTS", 2)
    monkeypatch.setattr(linedup, "HOT_PART", 10**9)
    assert sorted(linedup.deduplicate(docs).select("doc_id", "deduped.text").collect()) == want


def test_line_dedup_by_shuffle_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(linedup.deduplicate(docs).select("doc_id", "deduped.text").collect())
    monkeypatch.setattr(linedup, "BROADCAST_BYTES", -1)
    assert sorted(linedup.deduplicate(docs).select("doc_id", "deduped.text").collect()) == want


def test_patience_is_linear_in_piles():
    import random
    import time

    lines = list(range(40_000))
    for other in (lines, lines[::-1], random.Random(2).sample(lines, len(lines))):
        began = time.time()
        linedup.patience(lines, other)
        assert time.time() - began < 5


def test_line_dedup_deletes_what_the_first_keeps(spark):
    out = queries.op7_line_alignment(spark, "/root/testdata/sf0.001")
    assert out.filter("copy_of IS NOT NULL AND n_deleted <> n_lines").count() == 0
    assert out.filter("n_deleted > n_lines").count() == 0


def test_frequent_short_lines_and_passages_are_cut(spark):
    verse = "roses are red\nviolets so blue\nsugar tastes sweet"  # runs of short lines
    rows = [(1, "own first\nroses are red"), (2, "violets so blue\nown second\nsugar tastes sweet")]
    rows += [(i, f"page {i}\nall rights reserved by the press\n{verse}\nend {i}") for i in range(10, 90)]
    got = {r["doc_id"]: r["deduped"]["text"] for r in linedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1, 2, 10)] == [t for _, t in rows[:3]]
    assert all(got[i] == f"page {i}\nend {i}" for i in range(11, 90))


def test_runs():
    assert set(p for v in linedup.runs([b"a", b"b", b"", b"c", b"d"], [5, 3, 0, 2, 1], 5).values() for p in v) == {(0, 1), (1, 4), (0, 2), (1, 5)}
    assert linedup.runs([], [], 5) == {} == linedup.runs([b"a"], [4], 5)


def test_moved_and_repeated_blocks_are_cut(spark):
    a, b = "first passage of six plain words\nwith a second line", "second passage\nof other plain words here"
    rows = [(1, f"{a}\nbetween them\n{b}"), (2, f"two\n{b}\nand then\n{a}\nend two"), (3, f"three\n{a}\nonce more\n{a}\nagain\n{a}\nend three")]
    got = {r["doc_id"]: r["deduped"]["text"] for r in linedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "two\nand then\nend two", 3: "three\nonce more\nagain\nend three"}


def test_exploded_bands_are_not_broadcast_for_their_estimate(spark, monkeypatch):
    plans, keep = [], common.stored

    def noted(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, **options)

    # 40 bands a class, of which Spark takes one for an estimate far below its threshold.
    rows = [(n, [n // 2 * 40 + b if b < 3 else n * 1000 + b for b in range(40)]) for n in range(300)]
    classes = keep(spark.createDataFrame(rows, "node long, bands array<long>"))
    for module in (common, jaccard):
        monkeypatch.setattr(module, "stored", noted)
    units = jaccard._units(classes, 1024)
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]
    assert units.select("node").distinct().count() == 300 and units.select("unit").distinct().count() == 150
