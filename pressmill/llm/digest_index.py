"""Exact deduplication against a persistent index of digests.

The index is a Parquet table, bucketed and sorted by digest, so that the sort-merge
anti-join of new digests with it moves only the new ones; a bucket has a file for
each batch, whose sorted rows Spark merges by sorting the bucket again.  Only the
narrow digests of new rows are shuffled; texts are read once and never moved.
Equal digests are counted before the shuffle, so a text that makes up a third of
all rows is a handful of partial counts.

The number of buckets follows the rows (``BUCKET_ROWS`` each); ``rebuilt`` makes an
index with more buckets out of one that has grown.  One writer at a time.

``add`` may be repeated, after a failure at any point: what is in the index isn't
appended again, and the rows that the index names are kept again, so the same call
gives the same answer.

Defined results: a null text counts as empty.  Of equal texts of one batch the
largest id stays; a text that an earlier batch brought is dropped in favour of
the row in the index.  A row of a later batch that has the index's id and text is
that document, delivered again, and is kept.  Null ids stay only if no equal text
has an id; rows with a null id are kept again only under the name of the batch that
brought them.  Repeated rows of one id and text are the same document and share its
fate.  An empty batch adds nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, dropped, scratch_folder, stored
from .urlfilter import LOWER, UPPER

#: About 50 bytes a row: a bucket fits a task.
BUCKET_ROWS = 2_000_000


def text_digest(text: Column) -> Column:
    """SHA-256 of the text after lowering A-Z only, as bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256))


def buckets_for(spark: SparkSession, rows: int) -> int:
    """As many as the shuffles of the session have, or more if the rows need them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


#: A folder beside the data; Spark's readers pass over names with such a beginning.
RECORD = "_index"


def _record(spark: SparkSession, location: str) -> dict | None:
    """What the index at ``location`` was made with; null if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(location)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{location}/{RECORD}/_SUCCESS")):
        return spark.read.schema("buckets int, id_type string").json(f"{location}/{RECORD}").first().asDict()
    if fs.exists(at) and any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(at)):
        raise ValueError(f"{location} has data, but no record of its buckets")
    return None


class DigestIndex:
    """An index of digests at ``location``; opening it again finds what it holds.

    A record beside the data keeps the number of buckets and the type of ids, so neither
    is asked for again; another number or type raises an error."""

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None, id_type: str | None = None):
        made = _record(spark, location)
        if made is None:
            made = {"buckets": buckets or buckets_for(spark, 0), "id_type": id_type or "bigint"}
            spark.range(1).select(*[F.lit(v).alias(k) for k, v in made.items()]).coalesce(1).write.mode("overwrite").json(f"{location}/{RECORD}")
        asked = {"buckets": buckets, "id_type": id_type}
        if wrong := [k for k, v in asked.items() if v is not None and v != made[k]]:
            raise ValueError(", ".join(f"the index at {location} has {k} {made[k]}, not {asked[k]}" for k in wrong))
        buckets, id_type = made["buckets"], made["id_type"]
        self.spark, self.location, self.buckets, self.id_type = spark, location, buckets, id_type
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, location).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").option("path", self.location).saveAsTable(self.name)
        )

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Append what is new in ``docs``, a batch that may have a name.

        Returns a row for each row of the batch: ``doc_id, digest, keep_id,
        group_size, kept``; ``group_size`` counts rows of this batch."""
        batch = batch or uuid.uuid4().hex
        rows = stored(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")))
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("group_size"))
        fresh = stored(groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti"))
        self._append(fresh.select("digest", F.col("last_id").alias("keep_id"), F.lit(batch).alias("batch")))
        dropped(fresh)
        decided = stored(groups.join(self.table().hint("merge"), "digest").select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("own")))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") | F.col("doc_id").isNotNull())
        return rows.join(decided, "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))

    def rebuilt(self, location: str, buckets: int | None = None) -> DigestIndex:
        """The same index at another place, with buckets for the rows it has now."""
        held = self.table()
        out = DigestIndex(self.spark, location, buckets or buckets_for(self.spark, held.count()), self.id_type)
        out._append(held)
        return out

    def close(self, delete: bool = False) -> None:
        """Take the index out of the catalog; with ``delete``, its files too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if delete:
            _delete(self.spark, self.location)


def new_index(spark: SparkSession, rows: int = 0, **options) -> DigestIndex:
    """An empty index in the shared folder, with buckets for ``rows`` rows."""
    options.setdefault("buckets", buckets_for(spark, rows))
    return DigestIndex(spark, f"{scratch_folder(spark)}/index_{uuid.uuid4().hex}", **options)
