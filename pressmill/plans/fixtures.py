"""Views of the given tables in the shapes that the operators expect.

Each view has a Spark form and, under the same name in ``SQL``, a DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    section = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 5 == 0, F.concat(F.lit('["'), "lang", F.lit('", "'), "source", F.lit('"]'))).otherwise(F.col("lang"))
    head = F.substring_index("text", "\n", 1)
    return d.join(labels.groupBy("doc_id").agg(F.max("quality").alias("label")), "doc_id", "left").select(
        "doc_id", head.alias("headline"), F.substr(F.col("text"), F.char_length(head) + 2).alias("description"), section.alias("section_raw"),
        F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("family"), "label",
    )


def capture_log(spark: SparkSession, sf: str) -> DataFrame:
    e, p = table(spark, sf, "events"), table(spark, sf, "pages")
    n = p.agg(F.count("*").alias("n"))
    return e.crossJoin(n).select("event_id", "ts", "event_type", (F.col("event_id") % F.col("n")).alias("page_id")).join(p.select("page_id", "url"), "page_id").select(
        "event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("ts"), F.when(F.col("event_type") == "error", "503").otherwise("200").alias("status"),
        F.when(F.col("event_type") == "purchase", "application/pdf").otherwise("text/html").alias("mimetype"), "url",
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    kind, url = F.col("page_id") % 4, F.col("url")
    toggled = F.when(F.startswith(url, F.lit("https")), F.concat(F.lit("http"), F.substr(url, F.lit(6)))).otherwise(F.concat(F.lit("https"), F.substr(url, F.lit(5))))
    link = F.when(kind == 0, url).when(kind == 1, toggled).when(kind == 2, F.regexp_replace(url, "[?#].*$", "")).otherwise(F.regexp_replace(url, "://", "://www."))
    return table(spark, sf, "pages").select("page_id", link.alias("article_link"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("true_label"))
    p = p.select("*", F.explode(F.array(F.lit("base"), F.lit("pert"))).alias("run")).select("*", F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("model_path"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "run", "model_path", "sample_id")), 1, 8), 16, 10).cast("long")
    p = p.withColumn("prob1", 0.3 * F.col("true_label") + 0.7 * draw / F.lit(4294967296.0))
    return p.withColumn("predicted_label", F.when(F.col("prob1") >= 0.5, 1).otherwise(0))


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of whole documents with 0-based positions."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("pos", "tok"))


def doc_words(spark: SparkSession, sf: str) -> DataFrame:
    """The same, a row a document."""
    return table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon of edges: neighbouring words of benchmark items with a relation and a
    weight, some of them more than once."""
    t = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), text.tokens(F.col("text")).alias("t"))
    pair = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(0))), lambda a, b: F.struct(a.alias("s"), b.alias("e")))
    p = t.filter(F.size("t") > 1).select("doc_id", F.explode(pair).alias("p")).filter("p.s IS NOT NULL AND p.e IS NOT NULL")
    return p.select(F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.concat(F.lit("R"), F.substring(F.md5(F.concat_ws(":", "p.s", "p.e")), 1, 1)).alias("rel"), (numeric.seeded(1, F.col("doc_id"), F.col("p.s"), F.col("p.e")) % 400 / 100).alias("weight"))


def concept_edges(spark: SparkSession, sf: str) -> DataFrame:
    return raw_edges(spark, sf).groupBy("start", "end", "rel").agg(F.max("weight").alias("weight"))


_SEED = "CAST(concat('0x', substr(md5({0}), 1, 8)) AS BIGINT)"

SQL = {
    "articles": """articles AS (
  SELECT d.doc_id, split_part(d.text, chr(10), 1) AS headline, substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS description,
    CASE WHEN d.doc_id % 7 = 0 THEN '' WHEN d.doc_id % 5 = 0 THEN '["' || lang || '", "' || source || '"]' ELSE lang END AS section_raw,
    CASE WHEN d.doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS family, l.label
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS label FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)""",
    "capture_log": """capture_log AS (
  SELECT e.event_id, strftime(e.ts, '%Y%m%d%H%M%S') AS ts, CASE WHEN event_type = 'error' THEN '503' ELSE '200' END AS status,
    CASE WHEN event_type = 'purchase' THEN 'application/pdf' ELSE 'text/html' END AS mimetype, p.url
  FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) n JOIN pages p ON p.page_id = e.event_id % n.n)""",
    "links": """links AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN CASE WHEN starts_with(url, 'https') THEN 'http' || substr(url, 6) ELSE 'https' || substr(url, 5) END
    WHEN 2 THEN regexp_replace(url, '[?#].*$', '') ELSE replace(url, '://', '://www.') END AS article_link FROM pages)""",
    "predictions": """predictions0 AS (
  SELECT doc_id AS sample_id, quality AS true_label, run, model_path, 0.3::DOUBLE * quality + 0.7::DOUBLE * CAST(concat('0x', substr(md5(concat_ws(':', run, model_path, doc_id)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS prob1
  FROM labels CROSS JOIN (VALUES ('base'), ('pert')) r(run) CROSS JOIN (VALUES ('m0'), ('m1')) m(model_path)),
predictions AS (SELECT *, CASE WHEN prob1 >= 0.5 THEN 1 ELSE 0 END AS predicted_label FROM predictions0)""",
    "item_tokens": """items AS (SELECT item_id AS doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM benchmark),
item_tokens AS (SELECT doc_id, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS tok FROM items)""",
    "doc_tokens": """toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents),
doc_tokens AS (SELECT doc_id, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS tok FROM toks)""",
    "raw_edges": """raw_edges AS (
  SELECT a.tok AS "start", b.tok AS "end", 'R' || substr(md5(a.tok || ':' || b.tok), 1, 1) AS rel,
    CAST(concat('0x', substr(md5(concat_ws(':', '1', a.doc_id, a.tok, b.tok)), 1, 8)) AS BIGINT) % 400 / 100.0::DOUBLE AS weight
  FROM item_tokens a JOIN item_tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1)""",
    "concept_edges": """concept_edges AS (SELECT "start", "end", rel, max(weight) AS weight FROM raw_edges GROUP BY ALL)""",
}
_NEEDS = {"raw_edges": ["item_tokens"], "concept_edges": ["item_tokens", "raw_edges"]}


def with_views(sql: str, *views: str) -> str:
    """``sql`` (with further ``name AS (...)`` parts before its SELECT, if any) after the views it uses."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    sql = sql.strip()
    return "WITH " + ",\n".join(SQL[n] for n in names) + ("\n" if sql.upper().startswith("SELECT") else ",\n") + sql
