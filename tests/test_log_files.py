import glob

import duckdb
from pyspark.sql import functions as F

from pressmill.operators import extract
from pressmill.plans import catalog, links


def test_log_is_written_as_files_in_order(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(links.scratch, "folder", lambda _: str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted(map(tuple, catalog.QUERIES["stream_log_latest"](spark, sf).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for name in ("events", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert got == sorted(duckdb.sql(catalog.ORACLE["stream_log_latest"]).fetchall())
    assert len(glob.glob(f"{tmp_path}/log/part-*")) > 1


def test_pages_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    extract.page_text(spark.range(1).select(F.col("id").alias("page_id"), F.lit("<p>").alias("html")))
    assert int(spark.conf.get(name)) == 1000
