"""From raw documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the one before it
kept, and is written as Parquet and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pressmill.llm import stages
from pressmill.llm.common import _delete, scratch_tables, shared_folder

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("decontaminate", stages.decontaminate),
    ("bpe", stages.tokenize),
]

#: The stages are beyond SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """The last stage's rows, in a folder of the shared one.

    A stage's folder is deleted once the next one is written.  With ``base``, a folder that
    the caller keeps, a run that was stopped goes on after its last whole stage."""
    base = base or f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    paths = [f"{base}/{number}_{name}" for number, (name, _) in enumerate(STAGES)]
    done = max((n for n, path in enumerate(paths) if _whole(spark, path)), default=-1)
    docs = spark.read.parquet(paths[done] if done >= 0 else f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        if number > done:
            with scratch_tables(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[number])
            docs = spark.read.parquet(paths[number])
            if number:
                _delete(spark, paths[number - 1])
    return docs


def _whole(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
