"""Matching article links with archive captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import stripped


def capture_fields(lines: DataFrame, col: str = "value", status: str = "200", mimetype: str = "text/html") -> DataFrame:
    """``lines`` with a struct ``capture`` of ``ts, url, status, mimetype``, null if a line
    isn't ``<timestamp> <url> [<status> [<mimetype>]]``.

    Fields stand between white space; timestamps have 8 to 14 digits and are padded to 14;
    what a short line lacks is ``status`` and ``mimetype``; further fields are passed over."""
    parts = F.split(stripped(F.col(col)), "\\s+")
    field = lambda n, other=None: F.coalesce(F.get(parts, F.lit(n)), F.lit(other))
    good = field(0).rlike("^[0-9]{8,14}$") & (F.size(parts) > 1)
    return lines.withColumn("capture", F.when(good, F.struct(F.rpad(field(0), 14, "0").alias("ts"), field(1).alias("url"), field(2, status).alias("status"), field(3, mimetype).alias("mimetype"))))


def parse_capture_lines(lines: DataFrame, col: str = "value", status: str = "200", mimetype: str = "text/html") -> DataFrame:
    """``ts, url, status, mimetype`` of the lines that are captures; others are dropped."""
    return capture_fields(lines, col, status, mimetype).filter("capture IS NOT NULL").select("capture.*")


def capture_line_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    """How many lines are captures, rejected and blank; one row."""
    blank = F.coalesce(stripped(F.col(col)), F.lit("")) == ""
    good = F.col("capture").isNotNull()
    return capture_fields(lines, col).agg(F.count_if(good).alias("captures"), F.count_if(~good & ~blank).alias("rejected"), F.count_if(blank).alias("blank"))


def capture_window(captures: DataFrame, start: str, end: str, status: str = "200", mimetype: str = "text/html") -> DataFrame:
    return captures.filter((F.col("status") == status) & (F.col("mimetype") == mimetype) & F.col("ts").between(start, end))


def latest_capture(captures: DataFrame, key: Column, ordinal: str = "event_id") -> DataFrame:
    """Latest timestamp and its URL per key; ties go to the smallest ordinal.

    ``max_by`` aggregates before the shuffle, so a hot key is no hot task."""
    best = F.max_by(F.struct("ts", "url"), F.struct(F.col("ts"), -F.col(ordinal)))
    return captures.withColumn("key", key).filter("key IS NOT NULL").groupBy("key").agg(best.alias("b"), F.count("*").alias("captures")).select("key", "b.ts", "b.url", "captures")


def tiered_capture(captures: DataFrame, key: Column) -> DataFrame:
    """Newest HTML capture with status 200 per key, else the newest other with 200."""
    best = F.max_by(F.struct("ts", "mimetype"), F.struct((F.col("mimetype") == "text/html").cast("int"), F.col("ts"), F.col("mimetype")))
    return captures.filter("status = '200'").withColumn("key", key).filter("key IS NOT NULL").groupBy("key").agg(best.alias("b")).select("key", "b.ts", "b.mimetype")


def cascade_match(links: DataFrame, captures: DataFrame, exact: Column, ident: Column, clean: Column, link_exact: Column, link_ident: Column, link_clean: Column, ordinal: str = "event_id") -> DataFrame:
    """Exact key, then id, then clean key; the first hit wins, and misses stay.

    Key columns for captures and links are given apart, so each side names its own."""
    index = lambda key, name: latest_capture(captures, key, ordinal).select(F.col("key").alias(f"k_{name}"), F.col("ts").alias(f"ts_{name}"))
    out = links.distinct().withColumns({"l_exact": link_exact, "l_ident": link_ident, "l_clean": link_clean})
    for name, key in (("exact", exact), ("ident", ident), ("clean", clean)):
        found = index(key, name)
        out = out.join(found, F.col(f"l_{name}") == F.col(f"k_{name}"), "left").drop(f"k_{name}")
    by = F.when(F.col("l_clean").isNull(), "invalid").when(F.col("ts_exact").isNotNull(), "exact").when(F.col("ts_ident").isNotNull(), "id").when(F.col("ts_clean").isNotNull(), "key").otherwise("none")
    ts = F.when(F.col("l_clean").isNotNull(), F.coalesce("ts_exact", "ts_ident", "ts_clean"))
    return out.withColumns({"matched_by": by, "ts": ts}).withColumn("wayback_url", urls.capture_url(F.col("ts"), F.col("l_clean")))


def match_funnel(matched: DataFrame) -> DataFrame:
    """Counters of the cascade; a later hit still counts the earlier misses."""
    ok = F.col("l_clean").isNotNull()
    late = ok & F.col("ts_exact").isNull()
    last = late & F.col("ts_ident").isNull()
    return matched.agg(
        F.count("*").alias("links"), F.count_if(~ok).alias("invalid_clean"), F.count_if(F.col("matched_by") == "exact").alias("matched_by_exact"),
        F.count_if(F.col("matched_by") == "id").alias("matched_by_id"), F.count_if(F.col("matched_by") == "key").alias("matched_by_key"), F.count_if(late).alias("exact_not_found"),
        F.count_if(late & F.col("l_ident").isNull()).alias("no_id"), F.count_if(late & F.col("l_ident").isNotNull() & F.col("ts_ident").isNull()).alias("id_not_found"),
        F.count_if(last & F.col("ts_clean").isNull()).alias("key_not_found"), F.count_if(F.col("matched_by") == "none").alias("unmatched"),
    )


def first_variant(links: DataFrame, index: DataFrame, link_col: str = "article_link") -> DataFrame:
    """Each link with the row of ``index(key, ...)`` that its first URL variant found there has."""
    tried = links.select(link_col).distinct().select(link_col, F.posexplode(F.array_distinct(F.transform(urls.variants(F.col(link_col)), urls.canonical_key))).alias("pos", "key"))
    hit = tried.join(index, "key").groupBy(link_col).agg(F.min_by(F.struct(*index.columns), "pos").alias("b"), F.min("pos").alias("pos"))
    return links.select(link_col).distinct().join(hit.select(link_col, "b.*", "pos"), link_col, "left")


def variant_match(links: DataFrame, captures: DataFrame, link_col: str = "article_link", ordinal: str = "event_id") -> DataFrame:
    """The first URL variant of a link that the canonical index holds wins."""
    return first_variant(links, latest_capture(captures, urls.canonical_key(F.col("url")), ordinal).select("key", "ts"), link_col)


def tiered_variant_match(links: DataFrame, captures: DataFrame, link_col: str = "article_link") -> DataFrame:
    """The first URL variant with a capture of status 200 wins, by ``tiered_capture``."""
    return first_variant(links, tiered_capture(captures, urls.canonical_key(F.col("url"))), link_col)


def missing(links: DataFrame, known: DataFrame, col: str = "article_link") -> DataFrame:
    return links.select(col).distinct().join(known.select(col), col, "left_anti")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def host_check(links: DataFrame, col: str, domains: list[str], examples: int) -> DataFrame:
    """``examples`` links that are outside ``domains`` or have no host, with ``all_valid``
    false; a single row with a null link and true if there are none."""
    ok = F.coalesce(urls.in_family(urls.host_no_www(F.col(col)), domains), F.lit(False))
    bad = links.filter(~ok).select(col).distinct().orderBy(col).limit(examples).withColumn("all_valid", F.lit(False))
    whole = links.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_valid")).filter("all_valid")
    return bad.union(whole.select(F.lit(None).cast("string").alias(col), "all_valid"))


def key_sketches(captures: DataFrame, part: Column, keys: dict[str, Column], lg_k: int = 14) -> DataFrame:
    """``part`` and a mergeable sketch of each key's distinct values, a row a part; with
    ``lg_k`` 14 the standard error of an estimate is below 0.8 %."""
    return captures.groupBy(part.alias("part")).agg(*[F.hll_sketch_agg(c, F.lit(lg_k)).alias(n) for n, c in keys.items()])


def sketch_counts(sketches: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Estimates of distinct keys over parts, kept sketches merged rather than rows read."""
    return sketches.groupBy(*(by or [])).agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(k)), F.lit(0)).alias(k) for k in keys])
