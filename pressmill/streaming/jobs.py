"""Resumable and continuous forms of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import urls
from ..operators import extract
from ..operators.scratch import stored


def _until_used_up(stream: DataFrame, each, checkpoint: str):
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB, which isn't bounded by memory."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _observed(out: DataFrame, number: int, progress: str | None, write, **counts: Column) -> None:
    """Write ``out`` and, beside it, what it had: counted while it is written."""
    if progress is None:
        write(out)
        return
    seen = Observation(f"batch_{number}")
    write(out.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in counts.items()]))
    values = {"rows": 0, **dict.fromkeys(counts, 0), **seen.get}
    row = [F.lit(number).cast("long").alias("batch"), *[F.lit(v or 0).cast("long").alias(n) for n, v in values.items()]]
    out.sparkSession.range(1).select(*row).coalesce(1).write.mode("overwrite").json(f"{progress}/batch_{number}")


def read_progress(spark: SparkSession, progress: str, columns: str = "batch long, rows long, kept long, failed long") -> DataFrame:
    """A row for each batch that is done."""
    return spark.read.schema(columns).json(f"{progress}/batch_*") if _exists(spark, progress) else spark.createDataFrame([], columns)


def enrich_stream(spark: SparkSession, pages_path: str, schema: str, out: str, checkpoint: str, at: str | None = None, late: str = "7 days", progress: str | None = None):
    """Metadata of new page files, in a folder of ``out`` for each batch.

    Which pages are done is keyed state in the checkpoint, so a batch reads new files
    only, never ``out``.  With an event time ``at``, a page is forgotten once the
    watermark (``late``) has passed it, which bounds the state; then a page that comes
    again after that time is read again.  A batch that is repeated after a failure
    replaces its folder, so each page is there once.  ``progress``: a folder for rows
    read, kept and failed of each batch.  One page may have a null id."""

    def write(batch: DataFrame, number: int) -> None:
        failed = F.col("parse_error").isNotNull()
        _observed(extract.page_metadata(batch), number, progress, lambda df: df.write.mode("overwrite").parquet(f"{out}/batch={number}"), kept=F.count_if(~failed), failed=F.count_if(failed))

    stream = spark.readStream.schema(schema).parquet(pages_path)
    new = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["page_id"]) if at else stream.dropDuplicates(["page_id"])
    with _state_on_disk(spark):
        return _until_used_up(new, write, checkpoint)


LATEST = "key string, ts string, ordinal long, url string"
#: Folders of one level that are merged into one of the next.
FAN = 8


def _folders(spark: SparkSession, out: str) -> set[tuple[int, int]]:
    """``(level, first batch)`` of each folder that is complete."""
    p, fs = _path(spark, f"{out}/level=*/first=*/_SUCCESS")
    found = [s.getPath().getParent() for s in fs.globStatus(p) or []]
    return {(int(f.getParent().getName()[6:]), int(f.getName()[6:])) for f in found}


def _live(folders: set[tuple[int, int]], fan: int) -> list[tuple[int, int]]:
    """The folders that no complete folder of a higher level stands for."""
    out: list[tuple[int, int]] = []
    for level, first in sorted(folders, key=lambda f: (-f[0], f[1])):
        if not any(first // fan**above == begin // fan**above for above, begin in out if above > level):
            out.append((level, first))
    return out


def _newest(rows: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("ts", "ordinal", "url"), F.struct(F.col("ts"), -F.col("ordinal")))
    return rows.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def read_latest(spark: SparkSession, out: str, fan: int = FAN) -> DataFrame:
    """The latest capture of each key in the index at ``out``: its folders, merged as they
    are read."""
    paths = [f"{out}/level={level}/first={first}" for level, first in _live(_folders(spark, out), fan)]
    return _newest(spark.read.schema(LATEST).parquet(*paths)) if paths else spark.createDataFrame([], LATEST)


def latest_stream(spark: SparkSession, captures: str | DataFrame, schema: str | None, out: str, checkpoint: str, ordinal: str = "event_id", fan: int = FAN):
    """The latest capture per canonical URL, kept at ``out``; ties go to the smallest
    ordinal, as in ``latest_capture``.  ``captures``: a stream, or Parquet files with ``schema``.

    A batch is reduced to a row a key and written to a folder of its own: what it writes
    follows the batch, and the index isn't read.  Each ``fan`` folders of a level are
    merged into one of the next level, so a row is written again at most once a level
    (``log(batches)`` of them), and a reader meets fewer than ``fan`` folders a level.
    A folder counts once its ``_SUCCESS`` is there, and a batch that is repeated writes the
    same ones; folders that others stand for are deleted a batch later, so readers that
    have begun may end."""

    def merge(batch: DataFrame, number: int) -> None:
        there = _folders(spark, out)
        for level, first in there - set(_live(there, fan)):
            p, fs = _path(spark, f"{out}/level={level}/first={first}")
            fs.delete(p, True)
        new = batch.withColumn("key", urls.canonical_key(F.col("url"))).filter("key IS NOT NULL").select("key", "ts", F.col(ordinal).cast("long").alias("ordinal"), "url")
        _newest(new).write.mode("overwrite").parquet(f"{out}/level=0/first={number}")
        level = 0
        while (number + 1) % fan ** (level + 1) == 0:
            first = number + 1 - fan ** (level + 1)
            own = sorted(f for at, f in _folders(spark, out) if at == level and f >= first)
            parts = spark.read.schema(LATEST).parquet(*[f"{out}/level={level}/first={f}" for f in own])
            level += 1
            _newest(parts).write.mode("overwrite").parquet(f"{out}/level={level}/first={first}")

    stream = spark.readStream.schema(schema).parquet(captures) if isinstance(captures, str) else captures
    return _until_used_up(stream, merge, checkpoint)


def captures_per_day(captures: DataFrame) -> DataFrame:
    """Captures read and kept (HTML with status 200) per host and day."""
    ok = (F.col("status") == "200") & (F.col("mimetype") == "text/html")
    return captures.groupBy(urls.host_no_www(F.col("url")).alias("host"), F.substring("ts", 1, 8).alias("day")).agg(F.count("*").alias("read"), F.count_if(ok).alias("kept"))


SLICES = "batch long, read long, kept long, host string, day string"


def day_slices(spark: SparkSession, out: str) -> DataFrame:
    """The stored counts, one folder a host and day; see ``read_days``."""
    return spark.read.schema(SLICES).parquet(out) if _exists(spark, out) else spark.createDataFrame([], SLICES)


def read_days(spark: SparkSession, out: str) -> DataFrame:
    """``host, day, read, kept``."""
    return day_slices(spark, out).groupBy("host", "day").agg(F.sum("read").alias("read"), F.sum("kept").alias("kept"))


def per_day_stream(spark: SparkSession, captures_path: str, schema: str, out: str, checkpoint: str):
    """The same of new capture files, kept at ``out`` in a folder a host and day.

    A batch rewrites the folders of its own hosts and days only, late days included, and
    reads no other.  In a folder the counts of the last batch are a row of their own, so a
    batch that is repeated replaces what it gave."""

    def count(batch: DataFrame, number: int) -> None:
        new = stored(captures_per_day(batch).withColumn("batch", F.lit(number).cast("long")))
        days = [r["day"] for r in new.select("day").distinct().collect()]  # of one batch
        if not days:
            return
        same = F.col("host").eqNullSafe(F.col("new_host")) & F.col("day").eqNullSafe(F.col("new_day"))
        touched = new.select(F.col("host").alias("new_host"), F.col("day").alias("new_day"))
        before = day_slices(spark, out).filter(F.col("day").isin(days) | F.col("day").isNull()).filter(F.col("batch") != number).join(touched, same, "left_semi")
        before = before.groupBy("host", "day").agg(F.sum("read").alias("read"), F.sum("kept").alias("kept"), F.max("batch").alias("batch"))
        both = new.unionByName(before).repartition("host", "day")
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("host", "day").parquet(out)

    return _until_used_up(spark.readStream.schema(schema).parquet(captures_path), count, checkpoint)


def captures_per_day_stream(captures: DataFrame, event_time: str = "at", late: str = "2 days") -> DataFrame:
    """The same over a stream; days close when the watermark has passed them."""
    ok = (F.col("status") == "200") & (F.col("mimetype") == "text/html")
    days = captures.withWatermark(event_time, late).groupBy(urls.host_no_www(F.col("url")).alias("host"), F.window(event_time, "1 day").alias("day"))
    return days.agg(F.count("*").alias("read"), F.count_if(ok).alias("kept")).select("host", F.col("day.start").alias("day"), "read", "kept")


class ProgressTable(StreamingQueryListener):
    """Appends a row for each batch of any query: rows read, rows a second, seconds, and what
    the stream's ``observe`` counted.  ``spark.streams.addListener(ProgressTable(spark, path))``."""

    SCHEMA = "query string, run string, batch long, at string, rows long, rows_per_second double, seconds double, observed map<string, map<string, string>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = {name: {k: str(v) for k, v in row.asDict().items()} for name, row in (p.observedMetrics or {}).items()}
        row = (str(p.id), str(p.runId), p.batchId, p.timestamp, p.numInputRows, p.processedRowsPerSecond, p.batchDuration / 1000, seen)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(self.path)


def progress(query) -> dict:
    """Rows read and batch number of a query's last batch."""
    p = query.lastProgress
    return {"batch": p["batchId"], "rows": p["numInputRows"]} if p else {}
