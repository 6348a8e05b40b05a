"""Scores of predictions and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .numbering import id_chunks, numbered


def binary_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    y, p = F.col("true_label") == 1, F.col("predicted_label") == 1
    c = preds.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n")), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)})


def metric_delta(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """b minus a for keys that both have."""
    x = a.select(key, *[F.col(m).alias(f"{m}_a") for m in metrics])
    y = b.select(key, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return x.join(y, key).withColumns({f"delta_{m}": F.col(f"{m}_b") - F.col(f"{m}_a") for m in metrics})


def batch_loss(preds: DataFrame, model: str, order: str, p_true: Column, batch: int) -> DataFrame:
    """Cross entropy as the mean over batches of the batches' means."""
    each = numbered(preds.select(model, order, p_true.alias("_p")), [model], [F.col(order)], id_chunks(preds, order))
    each = each.groupBy(model, F.floor((F.col("rn") - 1) / batch).alias("_b")).agg(F.avg(-F.log("_p")).alias("l"))
    return each.groupBy(model).agg(F.avg("l").alias("loss"), F.count("*").alias("batches"))


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both runs' predictions of each sample; a sample of one run alone is an error."""
    x = a.select(*keys, "true_label", F.col("predicted_label").alias("pred_a"), F.col("confidence").alias("conf_a"))
    y = b.select(*keys, F.col("predicted_label").alias("pred_b"), F.col("confidence").alias("conf_b"))
    both = x.join(y, keys, "full_outer")
    lone = F.col("pred_a").isNull() | F.col("pred_b").isNull()
    return both.withColumn("pred_b", F.when(lone, F.raise_error(F.lit("the runs have different samples"))).otherwise(F.col("pred_b")))


def stability(pairs: DataFrame, *model: str) -> DataFrame:
    """Counts per model, or per model and another column (replaced or not)."""
    ok_a, ok_b = F.col("pred_a") == F.col("true_label"), F.col("pred_b") == F.col("true_label")
    return pairs.groupBy(*model).agg(
        F.count("*").alias("n"), F.count_if(F.col("pred_a") != F.col("pred_b")).alias("changed"), F.count_if(ok_a & ~ok_b).alias("correct_to_incorrect"), F.count_if(~ok_a & ok_b).alias("incorrect_to_correct"),
        F.count_if(~ok_a & ~ok_b).alias("unchanged_wrong"), F.avg(F.col("conf_b") - F.col("conf_a")).alias("mean_delta_confidence"),
    ).withColumns({"net": F.col("incorrect_to_correct") - F.col("correct_to_incorrect"), "change_rate": ratio(F.col("changed"), F.col("n"))})


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def transition_pairs(df: DataFrame, group: list[str], a: str, b: str, n: int = 8) -> DataFrame:
    counted = df.groupBy(*group, a, b).agg(F.count("*").alias("pairs"))
    return top_per_group(counted, group, [F.desc("pairs"), F.col(a), F.col(b)], n)


def epoch_delta(df: DataFrame, series: str, epoch: str, value: str) -> DataFrame:
    w = Window.partitionBy(series).orderBy(epoch)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))


def last_values(df: DataFrame, series: str, epoch: str, value: str) -> DataFrame:
    """Each series with the value of its last epoch, the highest first."""
    last = df.groupBy(series).agg(F.max(epoch).alias(epoch), F.max_by(value, epoch).alias(value))
    return last.orderBy(F.desc(value), series)
