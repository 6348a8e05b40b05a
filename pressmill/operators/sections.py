"""Section labels: counting, pooling, standardising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

MISSING = "<missing>"


def category_counts(df: DataFrame, labels: Column, source: Column, sources: list[str]) -> DataFrame:
    """Rows per category, in all, per known source and for the rest."""
    cells = F.when(F.size(labels) == 0, F.array(F.lit(MISSING))).otherwise(labels)
    each = df.select(F.explode(cells).alias("section"), source.alias("_s"))
    return each.groupBy("section").agg(F.count("*").alias("total_count"), *[F.count_if(F.col("_s") == s).alias(f"{s}_count") for s in sources], F.count_if(~F.coalesce(F.col("_s").isin(sources), F.lit(False))).alias("other_count")).orderBy(F.desc("total_count"), F.lower("section"), "section")


def source_totals(df: DataFrame, labels: Column, source: Column) -> DataFrame:
    """Rows, rows without a label, and labels, per source and for all sources (``<all>``)."""
    d = df.select(F.coalesce(source, F.lit(MISSING)).alias("source"), F.size(labels).alias("_n"))
    per = d.rollup("source").agg(F.count("*").alias("rows"), F.count_if(F.col("_n") == 0).alias("without_label"), F.sum("_n").alias("labels"))
    return per.withColumn("source", F.coalesce("source", F.lit("<all>")))


def standardise(df: DataFrame, labels: Column, mapping: DataFrame, id_col: str, default: str = "other") -> DataFrame:
    """Labels looked up in ``mapping(raw, standard)``, sorted and joined; those mapped to
    blank are dropped."""
    each = df.select(id_col, F.explode_outer(labels).alias("label"))
    looked = each.join(mapping, F.lower("label") == F.col("raw"), "left").select(id_col, F.when(F.col("label").isNotNull(), F.coalesce("standard", F.lit(default))).alias("s"))
    return looked.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("s") != "", F.col("s")))), ", ").alias("section"))


def fallback(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns ``names`` that isn't null; those that ``df`` lacks don't count."""
    held = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def label_pool(counts: DataFrame, section: str = "section", count: str = "total_count") -> DataFrame:
    """Atomic labels with summed counts; the missing label isn't one."""
    each = counts.filter(F.col(section) != MISSING).select(F.explode(text.parse_sections(F.col(section))).alias("label"), count)
    return each.groupBy("label").agg(F.sum(count).alias("weight"))
