import json

import pytest
from pyspark.sql import functions as F

from pressmill.functions import text, urls
from pressmill.operators import annotate, enrich, evaluate, extract, features, match, models, numbering, perturb, sections
from pressmill.sources import files
from pressmill.streaming import jobs


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("url, want", [
    ("http://WWW.A.com/b/?q=1#f", "https://www.a.com/b?q=1"), ("https://a.com", "https://a.com/"), ("https://a.com:80/x/", "https://a.com:80/x"), ("no host", None), (None, None), ("  ", None),
])
def test_canonical_key(spark, url, want):
    got = one(spark, url, urls.canonical_key)
    assert got == want and (got is None or one(spark, got, urls.canonical_key) == got)


TIERS = [urls.IdTier("digits", 8, 10, after="-", ends=True), urls.IdTier("hex", 16, 16, after="__"), urls.IdTier("hex", 16, 16), urls.IdTier("digits", 4, prefix="n:")]


@pytest.mark.parametrize("url, want", [
    ("https://press.example/2020/some-story-20201231/amp?x=1", "20201231"), ("https://press.example/a-12345678b/x", None), ("https://press.example/a-123456789012/x", "n:123456789012"),
    ("https://press.example/0123456789abcdef/t__FEDCBA9876543210.html", "fedcba9876543210"), ("https://press.example/x_0123456789ABCDEF_y", "0123456789abcdef"), ("https://press.example/v1234567890123456789", None),
    ("https://press.example/page/2020?id=7", "n:2020"), ("https://press.example/page?id=77777", "n:77777"), ("https://press.example/p%252D87654321", "87654321"), ("https://press.example/a-87654321-b/c-11112222/d-33334444", "11112222"),
    ("https://press.example/1/22/333", None), ("", None), (None, None), ("-99999999", "99999999"),
])
def test_article_id(spark, url, want):
    assert one(spark, url, lambda c: urls.article_id(c, TIERS)) == want


def test_clean_exact_and_repair(spark):
    assert one(spark, "http://www.a.com//b///c/amp/?z=1", urls.clean_key) == "https://a.com/b/c"
    assert one(spark, "http://a.com/b?z=2&a=x+y&c", urls.exact_key) == "https://a.com/b?a=x y&c=&z=2"
    assert one(spark, "https://www.h.comhttp://b.com/x", lambda c: urls.repaired(c, "www.h.com")) == "http://b.com/x"
    v = one(spark, "http://a.com/b?q=1", urls.variants)
    assert v[0] == "http://a.com/b?q=1" and len(v) == len(set(v)) == 16 and "https://www.a.com/b/" in v
    caps = one(spark, "https://web.archive.org/web/2020/https://www.h.com/a.html", lambda c: urls.capture_variants(c, "www.h.com", "www.p.com"))
    assert [c.split("/web/2020/")[1] for c in caps] == ["https://www.h.com/a.html", "https://www.p.com/a.html", "https://www.h.com/a", "https://www.p.com/a"]


def test_text(spark):
    assert one(spark, "NEW YORK—text", text.strip_dateline) == "text"
    assert one(spark, "text — not a dateline", text.strip_dateline) == "text — not a dateline"
    assert one(spark, "WASHINGTON, D.C.—text", text.strip_dateline) == "text"
    assert set(one(spark, " ".join(text.NEGATIONS[:5]), text.bag_of_words).split()) == {"not", "no", "nor", "never", "neither"}
    assert one(spark, "['a', 'b']", text.parse_sections) == ["a", "b"] and one(spark, "a, b,", text.parse_sections) == ["a", "b"] and one(spark, None, text.parse_sections) == []
    assert one(spark, "News, news , SPORT,", text.keywords) == ["News", "SPORT"]
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label")) for a, b, c in ((7, 10, "PERSON"), (16, 21, "GPE"), (0, 5, "GPE"))])
    assert one(spark, "PARIS— Ann met Berlin x", lambda c: text.mask_spans(c, spans, ["PERSON"])) == "[PERSON] met Berlin x"


def test_section_counts_from_csv(spark, tmp_path):
    (tmp_path / "counts.csv").write_text('section,total_count,a,b\nsports,5,2,3\n"news, other",3,1,2\n<missing>,2,2,0\n')
    df = files.read_csv(spark, f"file://{tmp_path}/counts.csv", "section string, total_count int, a int, b int")
    assert df.agg(F.sum("total_count"), F.sum("a"), F.sum("b")).first()[:] == (10, 5, 5)
    assert {r["label"]: r["weight"] for r in sections.label_pool(df).collect()} == {"sports": 5, "news": 3, "other": 3}


def test_split_shuffle_and_draws(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    share = {r["split"]: r["count"] / 20000 for r in perturb.seeded_split(df, "doc_id").groupBy("split").count().collect()}
    assert abs(share["test"] - 0.2) < 0.02 and abs(share["validation"] - 0.2) < 0.02
    t = spark.createDataFrame([(i, " ".join(["w"] * (i % 13))) for i in range(200)] + [(500, None)], "doc_id long, t string")
    out = perturb.binned_shuffle(t, "doc_id", "t")
    assert sorted(str(r[0]) for r in out.select("shuffled").collect()) == sorted(str(r[0]) for r in t.select("t").collect())
    pool = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 1.0)], "label string, weight double")
    rows = spark.createDataFrame([(i, ["a"]) for i in range(300)] + [(1000, []), (1001, ["a", "b", "c"])], "doc_id long, own array<string>")
    got = {r["doc_id"]: r["replaced"] for r in perturb.replace_labels(rows, "doc_id", F.col("own"), pool).collect()}
    assert {got[i][0] for i in range(300)} == {"b", "c"} and got[1000] == [] and got[1001] == ["a", "b", "c"]


def test_metrics_and_alignment(spark):
    p = spark.createDataFrame([("m", 1, 1, 1, 0.9), ("m", 2, 0, 1, 0.6), ("m", 3, 1, 0, 0.7)], "model string, sample_id int, true_label int, predicted_label int, confidence double")
    r = evaluate.binary_metrics(p, ["model"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (1, 1, 1, 0.5)
    assert evaluate.binary_metrics(p.filter("true_label = 0 AND predicted_label = 0"), ["model"]).count() == 0
    with pytest.raises(Exception, match="different samples"):
        evaluate.stability(evaluate.paired(p, p.filter("sample_id < 3"), ["model", "sample_id"]), "model").collect()


PAGE = """<html><head><title> The  Title </title><meta name="description" content="Desc"><meta property="article:section" content="Meta section">
<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": "NewsArticle", "articleSection": "Sports", "keywords": ["A", "b", "a"], "author": [{"@type": "Person", "name": "Ann"}, "Bob"], "datePublished": "2020-01-01"}]}</script>
<script>var x = "<p>no</p>";</script></head><body><nav>menu</nav><article><p>""" + "word " * 60 + """</p></article><p>tail</p></body></html>"""


def test_page_extraction(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>" + "short but more than forty characters long, yes</p>")], "page_id long, html string")
    m = {r["page_id"]: r for r in extract.page_metadata(pages).collect()}
    assert m[1]["section"] == "Sports" and m[1]["title"] == "The Title" and m[1]["keywords"] == ["A", "b"] and m[1]["author_name"] == ["Ann", "Bob"] and m[1]["author_type"] == ["Person"] and m[1]["published_date"] == "2020-01-01"
    assert m[2]["title"] is None and len(m) == 3
    t = {r["page_id"]: r for r in extract.page_text(pages).collect()}
    assert t[1]["article_text"].startswith("word word") and t[1]["description"] == "Desc" and t[3]["article_text"].startswith("short") and t[2]["article_text"] is None
    avoid = extract.field_choice(extract.page_candidates(pages), {"section": ["sports"]}).filter("field = 'section'").first()
    assert avoid["value"] == "Meta section"


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "x", "v": 1}\n\n{"v": 2}\nnot json\n')
    (tmp_path / "b.json").write_text(' [{"k": "x", "v": 1}, {"k": "y", "v": 2}]')
    (tmp_path / "c.log").write_text("20200101 http://a/\nbad http://b/\n20200101123456 http://c/ x\n\n123 http://d\n")
    at = f"file://{tmp_path}"
    assert files.jsonl_stats(spark, f"{at}/a.jsonl", "k string, v int", "k").first()[:] == (1, 1, 1)
    assert files.read_jsonl(spark, f"{at}/a.jsonl", "k string, v int").filter("_corrupt IS NULL").count() == 2
    assert files.read_json_auto(spark, f"{at}/b.json", "k string, v int").count() == 2 and files.read_json_auto(spark, f"{at}/a.jsonl", "k string, v int").filter("k = 'x'").count() == 1
    log = files.read_capture_log(spark, f"{at}/c.log").orderBy("ts").collect()
    assert [tuple(r) for r in log] == [("20200101000000", "http://a/", "200", "text/html"), ("20200101123456", "http://c/", "x", "text/html")]
    failed = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    files.append_dead_letters(failed, f"{at}/dead", "k")
    files.append_dead_letters(failed.union(spark.createDataFrame([("z",)], "k string")), f"{at}/dead", "k")
    assert sorted(json.loads(line)["k"] for p in (tmp_path / "dead").glob("*.json") for line in p.read_text().splitlines()) == ["x", "y", "z"]


def test_days_of_a_stream_close(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "at timestamp, status string, mimetype string, url string"
    rows = [("2024-01-01 10:00:00", "200", "text/html"), ("2024-01-01 11:00:00", "503", "text/html"), ("2024-01-09 00:00:00", "200", "text/html")]
    df = spark.createDataFrame([(*r, "http://www.a.com/") for r in rows], "at string, status string, mimetype string, url string")
    df.withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{at}/in")
    stream = jobs.captures_per_day_stream(spark.readStream.schema(schema).parquet(f"{at}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["host"], str(r["day"])[:10], r["read"], r["kept"]) for r in spark.read.parquet(f"{at}/out").collect()] == [("a.com", "2024-01-01", 2, 1)]
    assert jobs.progress(query)["batch"] >= 0


def test_numbering(spark):
    rows = [(i * 7 % 1000, "ab"[i % 3 == 0]) for i in range(1000)] + [(5000, None), (5001, None)]
    df = spark.createDataFrame(rows, "id long, g string")
    for chunk in (numbering.id_chunks(df, "id", 50), F.lit(0)):
        got = sorted((str(r["g"]), r["id"], r["rn"]) for r in numbering.numbered(df, ["g"], [F.col("id")], chunk).collect())
        want = []
        for g in ("a", "b", None):
            want += [(str(g), i, n) for n, i in enumerate(sorted(i for i, x in rows if x == g), 1)]
        assert got == sorted(want)
    key = df.withColumn("k", F.md5(F.col("id").cast("string")))
    got = [r["rn"] for r in numbering.numbered(key, [], [F.col("k")], numbering.digest_chunks(key, F.col("k"), 50)).orderBy("k").collect()]
    assert got == list(range(1, 1003))
    assert numbering.numbered(df.limit(0), ["g"], [F.col("id")], numbering.id_chunks(df.limit(0), "id")).count() == 0


def test_edges_and_marks_of_pages(spark, tmp_path):
    html = """<div id="wm-ipp"><a rel="tag">Toolbar</a><p>bar</p></div><nav aria-label="breadcrumb"><a>Home</a><a>World</a></nav><span class="x rubric">Rubric</span>
    <ul class="tags"><li><a>One</a></li><li><a>two</a></li></ul><a rel="tag nofollow">TWO</a><time datetime="2020"></time>"""
    m = extract.page_metadata(spark.createDataFrame([(1, html), (None, "<title>t</title>")], "page_id long, html string")).collect()
    m = {r["page_id"]: r for r in m}
    assert m[1]["section"] == "Rubric" and m[1]["keywords"] == ["TWO", "One"] and m[1]["published_date"] == "2020" and m[None]["title"] == "t"
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text("<p>x</p>")
    page = files.read_pages(spark, f"file://{tmp_path}/pages").first()
    assert page["url"].endswith("a.html") and page["html"] == "<p>x</p>"
    with pytest.raises(ValueError, match="missing: b, c"):
        enrich.require_columns(spark.range(1), ["id", "b", "c"])
    assert one(spark, "the cat is not on a mat", lambda c: text.bag_of_words(c, F.array(F.lit("cat"), F.lit("not")))) == "the is not on a mat"


def test_classic_models_share_features(spark):
    rows = [(i, ("good fine nice " if i % 2 else "bad poor sad ") + f"word{i % 5} thing") for i in range(60)] + [(99, "zzz"), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    vocab = features.vocabulary(features.term_counts(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n")))
    weights = features.tfidf(features.term_counts(docs, "doc_id", "text"), vocab, "doc_id")
    model = features.nb_fit(weights, labels, vocab, "doc_id")
    got = {r["doc_id"]: r for r in features.nb_predict(docs, weights, model, "doc_id").collect()}
    assert len(got) == 62 and all(got[i]["predicted"] == i % 2 for i in range(60)) and got[99]["predicted"] == 0 == got[100]["predicted"]
    numbers = models.indexed(vocab)
    n = vocab.count()
    assert sorted(r["idx"] for r in numbers.collect()) == list(range(n))
    d = models.features(labels, weights, numbers, "doc_id", n)
    out = models.lr_predict(models.lr_fit(d, "label"), d, ["doc_id", "label"])
    assert out.filter("label <> predicted_label").count() == 0
    t = models.tune(d, d, "label", {"c": (0.1, 10.0), "max_iter": [50]}, 3)
    assert [r["trial"] for r in t.orderBy("trial").collect()] == [0, 1, 2] and t.filter("f1 = 1").count() == 3


def test_tuning_is_seeded():
    assert models.trials({"c": (0.1, 10.0), "k": [1, 2]}, 4) == models.trials({"c": (0.1, 10.0), "k": [1, 2]}, 4)


def test_annotator_is_passed_in(spark):
    def load():
        return lambda texts: [[(t.index("Ann"), t.index("Ann") + 3, "PERSON")] if "Ann" in t else [] for t in texts]

    df = spark.createDataFrame([(1, "é😀 Ann met"), (2, None), (3, "")] + [(i, "Ann") for i in range(4, 60)], "id long, t string")
    got = {r["id"]: r for r in annotate.annotate(df, load, "t").withColumn("m", text.mask_spans(F.col("t"), F.col("spans"), ["PERSON"])).collect()}
    assert got[1]["m"] == "é😀 [PERSON] met" and got[2]["spans"] == [] == got[3]["spans"] and all(got[i]["m"] == "[PERSON]" for i in range(4, 60))
    assert annotate.annotate(df.limit(0), load, "t").count() == 0
    with pytest.raises(Exception, match="0 answers to"):
        annotate.annotate(df, lambda: lambda texts: [], "t").collect()


def test_exact_split_and_totals(spark):
    for n, want in ((0, {}), (1, {"test": 1}), (11, {"test": 3, "validation": 2, "train": 6}), (100, {"test": 20, "validation": 20, "train": 60})):
        df = spark.range(n).withColumnRenamed("id", "doc_id")
        assert {r["split"]: r["count"] for r in perturb.exact_split(df, "doc_id").groupBy("split").count().collect()} == want
    df = spark.createDataFrame([("a", ["x", "y"]), ("a", []), (None, ["x"])], "s string, l array<string>")
    assert {tuple(r) for r in sections.source_totals(df, F.col("l"), F.col("s")).collect()} == {("a", 2, 1, 2), ("<missing>", 1, 0, 1), ("<all>", 3, 1, 3)}
    h = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 1.0), ("b", 1, 2.0)], "s string, e int, v double")
    assert [tuple(r) for r in evaluate.last_values(h, "s", "e", "v").collect()] == [("b", 1, 2.0), ("a", 2, 1.0)]


def test_variants_meet_tiers_and_keys_repeat(spark):
    caps = spark.createDataFrame([("http://a.com/x", "2022", "200", "application/pdf"), ("http://a.com/x/", "2020", "200", "text/html"), ("http://www.a.com/x", "2023", "200", "text/html"), ("http://b.com/", "2024", "503", "text/html")], "url string, ts string, status string, mimetype string")
    links = spark.createDataFrame([("http://a.com/x",), ("https://www.a.com/x?q=1",), ("http://b.com",), (None,)], "article_link string")
    got = {r["article_link"]: (r["key"], r["ts"]) for r in match.tiered_variant_match(links, caps).collect()}
    assert got == {"http://a.com/x": ("https://a.com/x", "2020"), "https://www.a.com/x?q=1": ("https://www.a.com/x", "2023"), "http://b.com": (None, None), None: (None, None)}
    a = spark.createDataFrame([("k", 1), ("k", 2), (None, 3), ("z", 4)], "k string, id int")
    snap = spark.createDataFrame([("k", "b"), ("k", "a"), (None, "n")], "k string, ts string")
    out = {r["id"]: (r["available"], r["ts"], r["body"]) for r in enrich.enrich(a, snap, spark.createDataFrame([("k", "y"), ("k", "x"), ("z", "w")], "k string, body string"), "k").collect()}
    assert out == {1: (True, "a", "x"), 2: (True, "a", "x"), 3: (False, None, None), 4: (False, None, None)}


def test_errors_are_logged(spark, tmp_path):
    failed = spark.createDataFrame([("x", "timeout"), ("x", "timeout"), ("x", "refused"), ("y", ""), ("z", None)], "k string, error string")
    files.append_errors(failed, f"file://{tmp_path}/errors", "k")
    files.append_errors(failed.filter("k = 'none'"), f"file://{tmp_path}/errors", "k")
    assert sorted((r["k"], r["error"]) for r in spark.read.json(f"file://{tmp_path}/errors").collect()) == [("x", "refused"), ("x", "timeout")]
