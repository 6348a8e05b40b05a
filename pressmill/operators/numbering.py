"""Row numbers in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def id_chunks(df: DataFrame, col: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    """The number of a row's range of ``col``, a number; ranges hold about ``chunk_rows`` rows."""
    n = -(-df.count() // chunk_rows)
    bounds = df.agg(F.percentile_approx(col, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col(col))) if bounds else F.lit(0)


def digest_chunks(df: DataFrame, digest: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    """The same for hex digests, which are spread evenly."""
    n = max(1, -(-df.count() // chunk_rows))
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int")


def numbered(df: DataFrame, group: list[str], order: list[Column], chunk: Column, name: str = "rn") -> DataFrame:
    """``df`` with ``name``, 1 and up in ``order`` inside each ``group``.

    ``chunk`` cuts that order into ranges.  Rows are numbered inside ranges, and the
    counts of a group's ranges, summed up in order, say where each range starts."""
    d = df.withColumn("_chunk", chunk)
    counts = d.groupBy(*group, "_chunk").agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_chunk").alias("_gc"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    on = F.col("_chunk") == F.col("_gc")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(*order))
    return d.withColumn("_own", own).join(first, on).select(*df.columns, (F.col("_first") + F.col("_own")).alias(name))
