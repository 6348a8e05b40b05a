import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.operators import graph, match, perturb
from pressmill.sources import files


def test_prefix_pairs_equal_all_pairs(spark):
    rows = [(d, w) for d, text in ((1, "a ab abc abd b ba bab é éa"), (2, "abc x xy"), (None, "q qq")) for w in text.split()]
    concepts = spark.createDataFrame([(d, w) for d, w in rows if len(w) < 3], "doc_id long, tok string")
    tokens = spark.createDataFrame([(d, w, n, 1) for n, (d, w) in enumerate(rows + rows[:3] + [(1, ""), (2, "xyz"), (2, "xy")])], "doc_id long, tok string, pos int, concept int")
    want = {(d, c, t, p) for d, c in {(r[0], r[1]) for r in concepts.collect()} for e, t, p, _ in tokens.collect() if d == e and t and (c.startswith(t) or t.startswith(c))}
    got = graph.concept_align(concepts, tokens.drop("concept")).collect()
    assert len(got) == len({tuple(r) for r in got}) and {(r["doc_id"], r["concept"], r["pos"]) for r in got} == {(d, c, p) for d, c, _, p in want}
    assert graph.concept_align(concepts.limit(0), tokens).count() == 0


def test_a_very_long_token_meets_its_prefixes(spark):
    long = "x" * 1_000_000
    concepts = spark.createDataFrame([(1, long[:n]) for n in (1, 10, 999_999)] + [(1, "y")], "doc_id long, tok string")
    tokens = spark.createDataFrame([(1, long, 0), (1, long[:5], 1)], "doc_id long, tok string, pos int")
    got = sorted((len(r["concept"]), r["pos"]) for r in graph.concept_align(concepts, tokens).collect())
    assert got == [(1, 0), (1, 1), (10, 0), (10, 1), (999_999, 0), (999_999, 1)]


def test_draws_follow_the_weights(spark):
    pool = spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 1.0), ("d", 0.0), ("own", 1000.0), (None, 5.0)], "label string, weight double")
    rows = spark.range(6000).withColumn("own", F.array(F.lit("own")))
    got = [r["replaced"] for r in perturb.draw_labels(rows, "id", F.col("own"), pool).collect()]
    n = Counter(x for r in got for x in r)
    assert set(n) == {"a", "b", "c"} and all(abs(n[x] / 6000 - p) < 4 * math.sqrt(p * (1 - p) / 6000) for x, p in (("a", 0.6), ("b", 0.3), ("c", 0.1)))
    # Two draws without replacement: the second is by weight among the rest.
    two = [tuple(r["replaced"]) for r in perturb.draw_labels(rows.withColumn("own", F.array(F.lit("own"), F.lit("z"))), "id", F.col("own"), pool, seed=7).collect()]
    p_ab = 0.6 * 0.3 / 0.4 + 0.3 * 0.6 / 0.7
    assert abs(two.count(("a", "b")) / 6000 - p_ab) < 4 * math.sqrt(p_ab * (1 - p_ab) / 6000)
    few = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None)], "id long, own array<string>")
    small = pool.filter("label IN ('a', 'b', 'c')")
    assert [r["replaced"] for r in perturb.draw_labels(few, "id", F.col("own"), small).orderBy("id").collect()] == [["a", "b", "c"], [], []]
    with pytest.raises(Exception, match="more labels than the pool has"):
        perturb.draw_labels(few, "id", F.array(*[F.lit(str(i)) for i in range(9)]), small).collect()


def test_a_pool_of_a_million_labels(spark, monkeypatch):
    pool = spark.range(1_000_000).select(F.concat(F.lit("label"), "id").alias("label"), (F.col("id") % 7 + 1).alias("weight"))
    rows = spark.range(200).withColumn("own", F.array(F.lit("label5"), F.lit("label6"), F.lit("none")))
    got = perturb.draw_labels(rows, "id", F.col("own"), pool).collect()
    assert all(len(set(r["replaced"])) == 3 and not {"label5", "label6"} & set(r["replaced"]) for r in got)
    with pytest.raises(ValueError, match="draw_labels"):
        perturb.replace_labels(rows, "id", F.col("own"), pool)
    monkeypatch.setattr(perturb, "POOL_BYTES", 1000)
    with pytest.raises(ValueError, match="POOL_BYTES"):
        perturb.draw_labels(rows, "id", F.col("own"), pool)


def test_sketches_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 20_000).cast("string").alias("k"), F.lit(None).cast("string").alias("none"))
    days = match.key_sketches(df, F.col("day"), {"k": F.col("k"), "none": F.col("none")})
    got = match.sketch_counts(days, ["k", "none"]).first()
    assert days.count() == 7 and abs(got["k"] - 20_000) < 400 and got["none"] == 0
    assert match.sketch_counts(days, ["k"], ["part"]).count() == 7


def test_a_killed_rewrite_leaves_the_old_list(spark, tmp_path):
    at, schema = f"file://{tmp_path}/list", "k string"
    assert files.read_committed(spark, at, schema).count() == 0
    files.commit_json(spark.createDataFrame([("a",)], schema), at)
    with pytest.raises(Exception, match="boom"):
        files.commit_json(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("boom"))).otherwise("b").alias("k")), at)
    assert [r["k"] for r in files.read_committed(spark, at, schema).collect()] == ["a"]
    files.commit_json(spark.createDataFrame([("c",)], schema), at)
    held = files.read_committed(spark, at, schema)  # a reader that has begun
    files.commit_json(spark.createDataFrame([("d",), ("e",)], schema), at)
    assert [r["k"] for r in held.collect()] == ["c"] and files.read_committed(spark, at, schema).count() == 2
    assert len(list((tmp_path / "list").glob("v_*"))) == 2


def test_an_incomplete_run_is_skipped(spark, tmp_path):
    at = f"file://{tmp_path}"
    for name, done in (("2024-01-01", True), ("2024-02-01", True), ("2024-03-01", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(f"a,b\n1,{name}\n")
        if done:
            (tmp_path / name / "results.json").write_text("{}")
    assert [r.rsplit("/", 1)[1] for r in files.run_folders(spark, at, "results.json")] == ["2024-01-01", "2024-02-01"]
    assert [tuple(r) for r in files.read_latest_run(spark, at, "results.json", "a int, b string").collect()] == [(1, "2024-02-01", "2024-02-01")]
    with pytest.raises(FileNotFoundError):
        files.read_latest_run(spark, at, "none.json", "a int")


def _model():
    def run(vectors, src, dst, rel, weight, n):
        out = vectors.sum(axis=(1, 2))
        flat = vectors.reshape(-1, vectors.shape[2])
        for s, d, r, w in zip(src, dst, rel, weight):
            out[d // vectors.shape[1]] += flat[s].sum() * w * (r + 1)
        return 1 / (1 + np.exp(-out[:n]))

    return run


def test_graph_batches_equal_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    nodes = [(d * 3, p, rng.normal(size=3).tolist()) for d in range(11) for p in range(1 + d % 4)] + [(99, 7, [1.0, 1.0, 1.0])]
    edges = [(d * 3, int(a), int(b), int(r), float(w)) for d in range(11) for a, b, r, w in zip(rng.integers(0, 1 + d % 4, 5), rng.integers(0, 1 + d % 4, 5), rng.integers(-1, 4, 5), rng.random(5))] + [(0, 0, 9, 1, 1.0)]
    max_len, want = 4, {}
    for d in sorted({n[0] for n in nodes if n[1] < max_len}):
        vec = np.zeros((1, max_len, 3))
        for e, p, v in nodes:
            if e == d and p < max_len:
                vec[0, p] = v
        own = [(a, b, r if 0 <= r < 3 else 0, w) for e, a, b, r, w in edges if e == d and a < max_len and b < max_len]
        want[d] = float(_model()(vec, *(np.array(c) for c in zip(*own)), 1)[0]) if own else float(_model()(vec, [], [], [], [], 1)[0])
    n = spark.createDataFrame(nodes, "doc_id long, pos int, vec array<double>").repartition(3)
    e = spark.createDataFrame(edges, "doc_id long, src int, dst int, rel_id int, weight double")
    for batch in (1, 3, 100):
        got = graph.score_batches(n, e, _model, batch, max_len, 3).collect()
        assert {r["doc_id"]: round(r["prob1"], 9) for r in got} == {d: round(p, 9) for d, p in want.items()}
        assert all(r["predicted_label"] == int(r["prob1"] >= 0.5) and r["confidence"] >= 0.5 for r in got)
    assert graph.score_batches(n, e.limit(0), _model, 4, max_len, 3).count() == 11
    assert graph.score_batches(n.limit(0), e, _model, 4, max_len, 3).count() == 0
