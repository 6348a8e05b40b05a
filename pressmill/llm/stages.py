"""What the corpus pipeline does with the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard, langid, linedup
from .common import BROADCAST_BYTES, fresh, small_batches, stored, stripped, unsized

#: A text whose best language is less sure than this is rejected.
MIN_SCORE = 0.3


def learning_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learnt from; the fourth held out has remainder 2."""
    return docs.filter(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or a language that can be told."""
    small_batches(spark)
    counts = langid.fit(learning_rows(docs))
    own = fresh("_language", docs.columns)
    judged = langid.identify(docs, counts, out_col=own)
    return judged.filter((F.col(f"{own}.lang_pred") != langid.UNKNOWN) & (F.col(f"{own}.score") >= MIN_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated blocks; drops documents of which nothing is left but white space."""
    own = fresh("_deduped", docs.columns)
    done = linedup.deduplicate(docs, out_col=own)
    changed = F.col(f"{own}.n_deleted") > 0
    done = done.filter(~changed | (stripped(F.col(f"{own}.text")) != ""))
    new = {"text": F.col(f"{own}.text"), "n_chars": F.char_length(f"{own}.text").cast("long")}
    return done.select(*[F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in docs.columns])


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with a key, which tells different texts of one id, or of null ids, apart
    and sorts by id, nulls last; its name, and another one that ``docs`` doesn't have."""
    key = fresh("_key", docs.columns)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    return docs.withColumn(key, own), key, fresh("_other_key", docs.columns)


def _sized(keys: DataFrame) -> DataFrame:
    """Keys that texts meet: broadcast if their number allows."""
    return F.broadcast(keys) if keys.count() * 256 <= BROADCAST_BYTES else unsized(keys)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, nulls
    last; one text, if several have that id."""
    small_batches(spark)
    keyed, key, other = _keyed(docs)
    found = stored(jaccard.similar(keyed, id_col=key).filter("n_links > 0").select(F.col("doc_id").alias(other), "class_id"))
    drop = _sized(found.filter(F.col(other) != F.col("class_id")).select(other).distinct())
    kept = keyed.join(drop, F.col(key) == F.col(other), "left_anti")
    again = found.filter(F.col(other) == F.col("class_id")).groupBy(other).count().filter("count > 1").select(other)
    again = _sized(again)
    if not again.isEmpty():  # equal rows: one of each stays
        one = kept.join(again, F.col(key) == F.col(other), "left_semi").dropDuplicates([key])
        kept = kept.join(again, F.col(key) == F.col(other), "left_anti").union(one)
    return kept.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    keyed, key, other = _keyed(docs)
    bad = stored(decontam.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).select(F.col("doc_id").alias(other)).distinct())
    bad = _sized(bad)
    return keyed.join(bad, F.col(key) == F.col(other), "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed) of each document, with digests of ids and decoded text."""
    small_batches(spark)
    done = docs.select("doc_id", "lang", "source", bpe.round_trip(F.col("text"), tokenizer_file()).alias("done"))
    return done.select(
        "doc_id", "lang", "source", F.col("done.ids").alias("token_ids"), (F.octet_length("done.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("done.ids", 256).alias("ids_sha256"), F.sha2(F.encode("done.text", "UTF-8"), 256).alias("decoded_sha256"),
    )
