"""Annotators (taggers, lemmatisers, entity finders) that the user passes in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,label:string>>"


def annotate(df: DataFrame, loader: Callable, text_col: str, name: str = "spans", kind: str = SPANS, batch: int = 16) -> DataFrame:
    """``df`` with ``name``, what an annotator says of each text, as type ``kind``.

    ``loader()`` makes the annotator once a task.  It takes a list of up to ``batch``
    texts (a null text is empty) and gives as many answers; another number is an error."""

    @F.pandas_udf(kind)
    def answers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        annotator = loader()
        for part in parts:
            texts, out = ["" if t is None else t for t in part], []
            for i in range(0, len(texts), batch):
                got = list(annotator(texts[i : i + batch]))
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError(f"{len(got)} answers to {len(texts[i : i + batch])} texts")
                out += got
            yield pd.Series(out, dtype=object)

    return df.withColumn(name, answers(text_col))


def span_texts(text, spans, label: str):
    """The texts of spans (0-based, end excluded) with a label, in order."""
    return F.transform(F.filter(spans, lambda s: s["label"] == label), lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"]))
