"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that an operator may ask Spark to broadcast.
BROADCAST_BYTES = 32 << 20


_resident: dict = {}


def _give_back() -> None:
    """Return freed memory of this worker to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def resident(key, make):
    """What ``make()`` gives, kept in this Python worker until another key is asked for.

    Spark uses workers again for later stages, so a worker must not go on holding
    the models of the stages before."""
    if key not in _resident:
        if _resident:
            _resident.clear()
            _give_back()
        _resident[key] = make()
    return _resident[key]


def no_model() -> None:
    """Let go of what ``resident`` keeps, in tasks that need no model."""
    resident(None, lambda: None)


#: Rows of a batch for Python: whole texts go through it, so batches are kept small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have this session hand texts to Python in batches of at most ``BATCH_ROWS`` rows;
    a smaller number that is set already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: What Unicode and Python take for white space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    """``text`` without white space at its ends; trimming looks through a whole text, so it
    is done only where there is some."""
    ends = F.left(text, F.lit(1)).isin(list(WHITE)) | F.right(text, F.lit(1)).isin(list(WHITE))
    return F.when(ends, F.btrim(text, F.lit(WHITE))).otherwise(text)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a temporary folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; whoever finds it after
    the application has ended may delete it."""
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


#: The stored tables of the run that is on in this thread.
_written: ContextVar[list[str]] = ContextVar("written", default=[])


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, keeps generated ids stable and survives the loss of
    an executor; the reread table has sizes that the planner can use.  An operator
    drops what its result doesn't read (``dropped``); the rest goes with ``clear``."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.get().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables of which no other table is still to be made."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)
        if t._stored_at in _written.get():
            _written.get().remove(t._stored_at)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what is stored inside, in this thread, at the end; results that read these
    tables must be written by then."""
    own: list[str] = []
    token = _written.set(own)
    try:
        yield
    finally:
        _written.reset(token)
        for path in own:
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete what is stored outside of any such block, when all results are written."""
    while _written.get():
        _delete(spark, _written.get().pop())


def unsized(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark must not broadcast of itself.

    It takes a stored table for as large as its compressed files, and an exploded column for
    one value a row, so it would send to the driver what is many times its estimate."""
    return df.hint("merge")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or a longer one, that is no column of ``taken``, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)`` of longs.

    Returns ``(node, root)`` for every node of an edge between two different
    nodes; ``root`` is the smallest node of its component.  Each round links
    every node's larger neighbours to its smallest one (large star) and then its
    smaller neighbours likewise (small star), so paths shrink geometrically.
    Minima are pre-aggregated before the shuffle and the joins back have one row
    a key on one side, so that AQE can split a hot node."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(unsized(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(unsized(least), "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
        )
        last, now = now, stored(small.distinct())
        dropped(last)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
