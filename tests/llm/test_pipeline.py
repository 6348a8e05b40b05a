import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pressmill.llm import common, queries, stages

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), before.schema)
        assert docs.columns == columns, name
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if name == "line_dedup":
            assert docs.filter("text IS NULL OR trim(text) = '' OR n_chars <> length(text)").count() == 0
        if name == "ngram_jaccard":
            from tests.llm.test_near_and_lines import brute

            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert ids == {i if n == 0 else c for (i, _), (c, n) in zip(rows, brute(rows))}
        if name == "decontaminate":
            bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not [r for r in docs.collect() if any(b in r["text"] for b in bench)]
            assert before.count() - docs.count() < 0.2 * before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count()
    for r in last[:20]:
        assert hashlib.sha256(r["token_ids"]).hexdigest() == r["ids_sha256"] and len(np.frombuffer(r["token_ids"], "<u4")) == r["n_tokens"]
    run = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in run.select("doc_id").collect()) == sorted(r["doc_id"] for r in last)


def test_stages_survive_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_every_query_takes_all_rows(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for q in ("op3_ppm_language", "op6_trie_bpe", "op7_line_alignment", "op10_jump_shards"):
        assert queries.QUERIES[q](spark, SF).count() == n
    assert stages.MIN_SCORE < 0.5


def test_near_copies_of_one_id(spark):
    text = " ".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " end", "en", "s", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.ngram_jaccard(spark, docs, SF).select(F.col("doc_id")).collect()
    assert sorted(str(r[0]) for r in kept) == ["1", "None"]


def test_texts_without_an_id_of_their_own_are_judged_alone(spark):
    """Null and repeated ids: only the near copy, the repeated row and the leak go."""
    text = " ".join(f"word{i}" for i in range(50))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 60").orderBy("item_id").first()["text"]
    rows = [(None, "an unrelated text that has no id"), (None, "and another one without it, quite different"), (None, text + " end"), (1, text), (2, "one text of the second id, which stays"), (2, text + " other end"), (3, "kept, kept, kept twice"), (3, "kept, kept, kept twice"), (4, "clean, though its id has a leak"), (4, leak), (None, leak + " " + text.replace("word", "more"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = sorted(((r["doc_id"], r["text"]) for r in stages.ngram_jaccard(spark, docs, SF).collect()), key=str)
    assert near == sorted([r for n, r in enumerate(rows) if n not in (2, 5, 7)], key=str)
    clean = sorted(((r["doc_id"], r["text"]) for r in stages.decontaminate(spark, docs, SF).collect()), key=str)
    assert clean == sorted(rows[:9], key=str)


def test_stages_keep_columns_of_any_name(spark):
    text = "\n".join(f"some quite different words of line {i} and of text %d" for i in range(8))
    names = ["_key", "d_key", "_other_key", "_language", "_deduped", "text_", "item_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, text.replace("%d", str(i)), "en", "s", len(text), *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert all([r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names] for r in got.collect()), name


def test_only_white_space_left_is_dropped(spark):
    block = "one two three four five six\nseven eight nine ten"
    rows = [(1, block), (2, f"\t\n{block}\n\n\u00a0\r"), (3, f"\t\n{block}\nmore"), (4, "\n\t")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in stages.line_dedup(spark, docs, SF).collect()}
    assert got == {1: block, 3: "\t\nmore", 4: "\n\t"}


def test_a_stopped_run_goes_on_and_leaves_one_folder(spark, tmp_path, monkeypatch):
    base, ran = f"file://{tmp_path}/run", []

    def stage(name, fails=False):
        def work(spark, docs, sf_dir):
            ran.append(name)
            if fails:
                raise RuntimeError("stopped")
            return common.stored(docs.filter("doc_id % 7 > 0")).filter("doc_id % 11 > 0")

        return name, work

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c", True)])
    for _ in range(2):
        try:
            corpus_pipeline.run(spark, SF, base)
        except RuntimeError:
            pass
    assert ran == ["a", "b", "c", "c"] and [p.name for p in (tmp_path / "run").iterdir()] == ["1_b"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c")])
    assert corpus_pipeline.run(spark, SF, base).filter("doc_id % 7 = 0").count() == 0
    assert ran[4:] == ["c"] and [p.name for p in (tmp_path / "run").iterdir()] == ["2_c"]


def test_runs_clear_their_own_tables(spark):
    df = spark.range(3).withColumnRenamed("id", "doc_id")
    outer = common.stored(df)
    with common.scratch_tables(spark):
        inner = common.stored(df)
        common.dropped(inner)
        left = common.stored(df)
        assert left.count() == 3
    assert outer.count() == 3
    common.clear(spark)
    common.dropped(outer)  # after clear: nothing to do
