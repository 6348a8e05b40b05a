"""Resumable enrichment of links with captures and page content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .match import first_per


def keyed_load(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """Rows with key and value; the first row of a key wins."""
    return first_per(rows.filter(~is_blank(F.col(key)) & ~is_blank(F.col(value))), [key], [F.col(ordinal)])


def load_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows kept, invalid and repeated, without a distinct of whole rows."""
    ok = ~is_blank(F.col(key)) & ~is_blank(F.col(value))
    per = rows.groupBy(F.when(ok, F.col(key)).alias("k")).agg(F.count("*").alias("n"))
    return per.agg(F.count("k").alias("kept"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("invalid"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def tagged_union(parts: dict[str, DataFrame], limit: int | None = None, order: str | None = None) -> DataFrame:
    out = None
    for tag, df in parts.items():
        df = df.withColumn("origin", F.lit(tag))
        out = df if out is None else out.unionByName(df)
    return out.orderBy("origin", order).limit(limit) if limit else out


def todo(links: DataFrame, state: DataFrame, key: str, rerun_errors: bool, rerun_misses: bool) -> DataFrame:
    """Links without a state, and errors or clean misses if these are rerun."""
    s = state.select(key, F.lit(True).alias("_known"), "available", "error")
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    again = (failed & F.lit(rerun_errors)) | (~failed & ~F.coalesce("available", F.lit(False)) & F.lit(rerun_misses))
    return links.join(s, key, "left").filter(F.col("_known").isNull() | again).select(*links.columns)


def resume(links: DataFrame, done: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """Links neither completed without an error nor given up."""
    good = done.filter(F.coalesce(F.col("error"), F.lit("")) == "").select(key)
    return links.join(good, key, "left_anti").join(dead.select(key), key, "left_anti")


def dead_letters(failed: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """What to append to the dead letters: new keys, once each."""
    return failed.select(key).distinct().join(dead.select(key), key, "left_anti")


def error_log(failed: DataFrame, key: str, error: str = "error") -> DataFrame:
    """What each key failed with, once each."""
    return failed.filter(F.coalesce(F.col(error), F.lit("")) != "").select(key, F.col(error).alias("error")).distinct()


def _once(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*") if rest else df.distinct()


def enrich(articles: DataFrame, snapshots: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """Each article once, with its snapshot, and content if there is a snapshot.

    Where a key has several snapshots or contents, the least row counts."""
    out = articles.join(_once(snapshots, key).withColumn("available", F.lit(True)), key, "left").join(_once(content, key), key, "left")
    out = out.withColumn("available", F.coalesce("available", F.lit(False)))
    return out.withColumns({c: F.when(F.col("available"), F.col(c)) for c in content.columns if c != key})


def merge_existing_wins(existing: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    both = existing.select(key, value, F.lit(0).alias("rank")).union(new.select(key, value, F.lit(1)))
    return both.groupBy(key).agg(F.min_by(value, F.struct("rank", value)).alias(value))


def outcome(available, error):
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(F.coalesce(available, F.lit(False)), "hit").otherwise("miss")
