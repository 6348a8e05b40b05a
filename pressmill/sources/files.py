"""Reading and writing the file formats of the pipelines, with explicit schemas."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import is_blank

CORRUPT = "_corrupt"


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't blank, as a struct ``j`` with what can't be parsed in ``_corrupt``."""
    given = spark.createDataFrame([], schema).schema
    shape = StructType([*given.fields, StructField(CORRUPT, StringType())])
    lines = spark.read.text(path).filter(~is_blank(F.col("value")))
    return lines.select(F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("j"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that isn't JSON keeps its text in ``_corrupt``."""
    return _parsed(spark, path, schema).select("j.*")


def jsonl_stats(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Lines that hold a key, lack it, or aren't JSON; blank lines don't count."""
    bad, has = F.col(f"j.{CORRUPT}").isNotNull(), ~is_blank(F.col(f"j.{key}").cast("string"))
    return _parsed(spark, path, schema).agg(F.count_if(~bad & has).alias("rows"), F.count_if(~bad & ~has).alias("without_key"), F.count_if(bad).alias("invalid"))


def read_json_auto(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines, told by the first character that isn't a space."""
    first = spark.read.text(path).filter(~is_blank(F.col("value"))).limit(1).collect()
    return spark.read.schema(schema).json(path, multiLine=bool(first) and first[0][0].lstrip().startswith("["))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_capture_log(spark: SparkSession, path: str) -> DataFrame:
    """Captures of log files, by Spark's own text reader."""
    from ..operators.match import parse_capture_lines

    return parse_capture_lines(spark.read.text(path))


def follow_capture_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the captures of log files that are added or grow, with the place of
    each line: ``ts, url, status, mimetype, path, at``."""
    from ..operators.match import capture_fields
    from . import capturelog

    capturelog.register(spark)
    lines = spark.readStream.format("capture_log").load(path)
    return capture_fields(lines).filter("capture IS NOT NULL").select("capture.*", "path", "at")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored page files as ``url`` (the path) and ``html``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.col("content").cast("string").alias("html"))


def latest_run(runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Rows of the newest run; run ids sort by time."""
    return runs.join(F.broadcast(runs.agg(F.max(run_col).alias(run_col))), run_col)  # one row


def run_folders(spark: SparkSession, root: str, required: str) -> list[str]:
    """The run folders below ``root`` that have the file ``required``, the oldest first; the
    names of runs sort by time.  A run that is being written, or was given up, lacks it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{required}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted({s.getPath().getParent().toString() for s in found})


def read_latest_run(spark: SparkSession, root: str, required: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """The rows of the files of the newest complete run, with its name as ``run``."""
    runs = run_folders(spark, root, required)
    if not runs:
        raise FileNotFoundError(f"no run below {root} has {required}")
    rows = spark.read.schema(schema).option("pathGlobFilter", pattern).csv(runs[-1], header=True, multiLine=True, escape='"')
    return rows.select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run"))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


POINTER = "current"


def commit_json(df: DataFrame, path: str) -> str:
    """Write rows as JSON lines in place of what ``read_committed`` gave before, or leave it.

    The rows go to a version of their own; one pointer file, put in place by a rename, then
    says which version counts, and versions before the last two are deleted.  A writer that
    is killed leaves the old rows.  One writer at a time."""
    spark = df.sparkSession
    fs_of = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    before, version = _current(spark, path), f"v_{time.time_ns():020d}"
    df.write.json(f"{path}/{version}")
    fs, staged = fs_of(place(path)), place(f"{path}/{POINTER}.{version}")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = rename
    context.rename(staged, place(f"{path}/{POINTER}"), options)
    for status in fs.listStatus(place(path)):
        name = status.getPath().getName()
        if name.startswith("v_") and name not in (before, version) or name.startswith(f"{POINTER}."):
            fs.delete(status.getPath(), True)
    return version


def _current(spark: SparkSession, path: str) -> str | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return bytes(spark.read.format("binaryFile").load(f"{path}/{POINTER}").first()["content"]).decode()


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the version that the pointer names; none if there isn't one."""
    version = _current(spark, path)
    return spark.read.schema(schema).json(f"{path}/{version}") if version else spark.createDataFrame([], schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json_arrays(df: DataFrame, path: str, part: Column) -> None:
    """A JSON array a file, with the rows of one ``part``; parts should be small."""
    rows = df.select(part.alias("part"), F.struct(*df.columns).alias("row")).groupBy("part").agg(F.to_json(F.array_sort(F.collect_list("row"))).alias("value"))
    rows.write.mode("overwrite").partitionBy("part").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def append_dead_letters(failed: DataFrame, path: str, key: str) -> None:
    """Append keys that aren't at ``path`` yet."""
    from ..operators.enrich import dead_letters

    spark = failed.sparkSession
    try:
        dead = spark.read.schema(f"{key} string").json(path)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        dead = spark.createDataFrame([], f"{key} string")
    append_jsonl(dead_letters(failed, dead, key), path)


def append_errors(failed: DataFrame, path: str, key: str, error: str = "error") -> None:
    """Append what keys failed with; unlike dead letters, each run's errors are kept."""
    from ..operators.enrich import error_log

    append_jsonl(error_log(failed, key, error), path)
