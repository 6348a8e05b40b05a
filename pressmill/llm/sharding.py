"""Shards by jump consistent hashing.

The id and the number of shards decide the shard, without a table of a ring.
Going from n to n + 1 shards moves one row in n + 1, and only into the new shard.
The generator is the published one, a linear congruence modulo 2^64; its product
is put together from halves because Spark's arithmetic raises on overflow.

A slot numbers the rows of a shard without gaps.  Each shard is cut into chunks
by a hash, rows are numbered inside chunks, and the chunks' counts, summed up in
order, give each chunk its first slot; so no shard has to fit one task.

Defined results: a null id has its own fixed key.  Repeated rows go to one shard
and get slots of their own.  Null texts have size 1 and the CRC-32 of nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CHUNK_ROWS = 50_000
MULTIPLIER = 2862933555777941757  # fixed by the published algorithm


def _next_state(key: Column) -> Column:
    """``key * MULTIPLIER + 1`` modulo 2^64, in 16- and 32-bit parts."""
    low32, mh, ml = 0xFFFFFFFF, MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    half = lambda x, by: F.shiftrightunsigned(x, 16).bitwiseAND(F.lit(0xFFFF)) if by else x.bitwiseAND(F.lit(0xFFFF))
    mod32 = lambda x, m: (half(x, 0) * F.lit(m) + F.shiftleft((half(x, 1) * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(low32))
    hi, lo = F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(low32))
    small = half(lo, 0) * F.lit(ml) + F.lit(1)
    middle = half(lo, 1) * F.lit(ml) + F.shiftrightunsigned(small, 16)
    low = F.shiftleft(middle.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(small.bitwiseAND(F.lit(0xFFFF)))
    high = (F.shiftrightunsigned(middle, 16) + mod32(hi, ml) + mod32(lo, mh)).bitwiseAND(F.lit(low32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a 64-bit key."""

    def leap(state: Column, _: Column) -> Column:
        key = _next_state(state["key"])
        step = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(key, 33) + 1).cast("double"))).cast("long")
        on = F.struct(key.alias("key"), state["next"].alias("at"), step.alias("next"))
        return F.when(state["next"] < shards, on).otherwise(state)

    # A key leaps about ln(shards) times, so a few steps do for nearly all; the rest go
    # on in stretches twice as long each time, up to the ``shards`` leaps there can be.
    stretches = [8]
    while sum(stretches) < shards:
        stretches.append(2 * stretches[-1])
    on = lambda s, n: F.when(s["next"] < shards, F.aggregate(F.sequence(F.lit(1), n), s, leap)).otherwise(s)
    start = F.struct(key.cast("long").alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.array(*map(F.lit, stretches)), start, on, lambda s: s["at"].cast("int"))


def stable_key(value: Column) -> Column:
    """A key that depends on the value alone."""
    return F.xxhash64(F.coalesce(value.cast("string"), F.lit("null")))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of every row."""
    text = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(bytearray()))
    key = stable_key(F.col(id_col))
    placed = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
            jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("row"),
        )
    )
    chunks = -(-placed.count() // (chunk_rows * shards)) or 1
    # The row number is stored, so equal ids may lie in different chunks.
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "row")
    return (
        placed.withColumn("nth", F.row_number().over(inside) - 1)
        .join(first, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard")
    )
