"""Queries over predictions, training history and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import evaluate
from . import fixtures as fx
from . import texts
from .fixtures import with_views

METRICS = ["accuracy", "precision", "recall", "f1"]


def _preds(spark, sf):
    p = fx.predictions(spark, sf)
    return p.withColumn("confidence", F.greatest("prob1", 1 - F.col("prob1")))


def _run(spark, sf, name):
    return _preds(spark, sf).filter(F.col("run") == name)


def _rounded(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def binary_metrics(spark, sf):
    return _rounded(evaluate.binary_metrics(_preds(spark, sf), ["run", "model_path"]), METRICS)


def _delta(spark, sf):
    a, b = (evaluate.binary_metrics(_run(spark, sf, r), ["model_path"]) for r in ("base", "pert"))
    return evaluate.metric_delta(a, b, "model_path", METRICS)


def metric_delta(spark, sf):
    d = _delta(spark, sf)
    return _rounded(d, d.columns[1:]).orderBy("delta_f1")


def headline_findings(spark, sf):
    d = _delta(spark, sf)
    return d.agg(F.max_by("model_path", "f1_a").alias("best_base"), F.max_by("model_path", "f1_b").alias("best_perturbed"), F.min_by("model_path", "delta_f1").alias("largest_drop"))


def batch_loss(spark, sf):
    p = F.when(F.col("true_label") == 1, F.col("prob1")).otherwise(1 - F.col("prob1"))
    return _rounded(evaluate.batch_loss(_run(spark, sf, "base"), "model_path", "sample_id", F.greatest(p, F.lit(1e-12)), 32), ["loss"])


def _pairs(spark, sf):
    return evaluate.paired(_run(spark, sf, "base"), _run(spark, sf, "pert"), ["model_path", "sample_id"])


def prediction_stability(spark, sf):
    return _rounded(evaluate.stability(_pairs(spark, sf), "model_path"), ["mean_delta_confidence", "change_rate"])


def top_regressions(spark, sf):
    p = _pairs(spark, sf).filter((F.col("pred_a") == F.col("true_label")) & (F.col("pred_b") != F.col("true_label"))).withColumn("delta", F.round(F.col("conf_b") - F.col("conf_a"), 9))
    return evaluate.top_per_group(p, ["model_path"], [F.col("delta"), F.col("sample_id")], 5).select("model_path", "sample_id", F.round("delta", 6).alias("delta"), "rank")


def transition_pairs(spark, sf):
    """Original to replaced sections of all samples whose sections were replaced, and of
    those that were judged right before and wrong after."""
    p = _replaced(spark, sf).filter("kind = 'replaced'")
    worse = (F.col("pred_a") == F.col("true_label")) & (F.col("pred_b") != F.col("true_label"))
    p = p.select("*", F.explode(F.when(worse, F.array(F.lit("all"), F.lit("regressions"))).otherwise(F.array(F.lit("all")))).alias("scope"))
    return evaluate.transition_pairs(p, ["model_path", "scope"], "original", "replacement")


def _replaced(spark, sf):
    """Both runs' predictions with the sections before and after their replacement."""
    s = texts.section_replace(spark, sf).select(F.col("doc_id").alias("sample_id"), F.col("own").alias("original"), F.col("replaced").alias("replacement"))
    return _pairs(spark, sf).join(s, "sample_id").withColumn("kind", F.when(F.col("original") != F.col("replacement"), "replaced").otherwise("unchanged"))


def section_stability(spark, sf):
    return _rounded(evaluate.stability(_replaced(spark, sf), "model_path", "kind"), ["mean_delta_confidence", "change_rate"])


def common_models(spark, sf):
    return _run(spark, sf, "base").select("model_path").intersect(_run(spark, sf, "pert").select("model_path"))


def label_decode(spark, sf):
    name = F.when(F.col("predicted_label") == 1, "sarcastic").otherwise("not sarcastic")
    return _run(spark, sf, "base").select("sample_id", F.concat("model_path", F.lit("_base")).alias("model"), name.alias("decoded"))


def softmax_argmax(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", numeric.argmax(F.col("v")).alias("predicted"), F.round(F.array_max(numeric.softmax(F.col("v"))), 6).alias("confidence"))


def vector_norm(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", F.round(numeric.l2_norm(F.col("embedding")), 4).alias("norm"))


def _history(spark, sf):
    """A training history: per event type the mean value of each day's events."""
    e = fx.table(spark, sf, "events")
    return e.groupBy("event_type", F.dayofmonth("ts").alias("epoch")).agg(F.avg("value").alias("train_loss"), F.count("*").cast("double").alias("test_f1"))


def epoch_delta(spark, sf):
    return _rounded(evaluate.epoch_delta(_history(spark, sf), "event_type", "epoch", "train_loss").select("event_type", "epoch", "train_loss", "delta"), ["train_loss", "delta"])


def epoch_ranking(spark, sf):
    return _rounded(evaluate.last_values(_history(spark, sf), "event_type", "epoch", "train_loss"), ["train_loss"])


def history_unpivot(spark, sf):
    return _rounded(_history(spark, sf).unpivot(["event_type", "epoch"], ["train_loss", "test_f1"], "metric", "value"), ["value"])


def history_wide(spark, sf):
    """The long form back to a column a metric."""
    long = _history(spark, sf).unpivot(["event_type", "epoch"], ["train_loss", "test_f1"], "metric", "value")
    return _rounded(long.groupBy("event_type", "epoch").pivot("metric", ["train_loss", "test_f1"]).agg(F.first("value")), ["train_loss", "test_f1"])


def best_trial(spark, sf):
    return _rounded(_history(spark, sf).orderBy(F.desc("test_f1"), "event_type", "epoch").limit(1).select("event_type", "epoch", "test_f1"), ["test_f1"])


def metric_text(spark, sf):
    """Deltas as signed text, as reports print them."""
    return _delta(spark, sf).select("model_path", numeric.signed(F.round("delta_f1", 4)).alias("delta_f1"))


QUERIES = {f.__name__: f for f in (binary_metrics, metric_delta, headline_findings, batch_loss, prediction_stability, top_regressions, transition_pairs, section_stability, history_wide, common_models, label_decode, softmax_argmax, vector_norm, epoch_delta, history_unpivot, best_trial, metric_text, epoch_ranking)}

_M = """c AS (SELECT run, model_path, count(*) AS n, count(*) FILTER (true_label = 1 AND predicted_label = 1) AS tp, count(*) FILTER (true_label <> 1 AND predicted_label = 1) AS fp,
  count(*) FILTER (true_label = 1 AND predicted_label <> 1) AS fn, count(*) FILTER (true_label <> 1 AND predicted_label <> 1) AS tn FROM predictions GROUP BY ALL),
c1 AS (SELECT *, coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c),
m AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM c1),
d AS (SELECT a.model_path, """ + ", ".join(f"a.{x} AS {x}_a, b.{x} AS {x}_b, b.{x} - a.{x} AS delta_{x}" for x in METRICS) + """ FROM m a JOIN m b ON a.model_path = b.model_path AND a.run = 'base' AND b.run = 'pert')
"""
_P = """p AS (SELECT a.model_path, a.sample_id, a.true_label, a.predicted_label AS pred_a, b.predicted_label AS pred_b, greatest(a.prob1, 1 - a.prob1) AS conf_a, greatest(b.prob1, 1 - b.prob1) AS conf_b
  FROM predictions a JOIN predictions b ON a.model_path = b.model_path AND a.sample_id = b.sample_id AND a.run = 'base' AND b.run = 'pert')
"""
_STABLE = """count(*) AS n, count(*) FILTER (pred_a <> pred_b) AS changed, count(*) FILTER (pred_a = true_label AND pred_b <> true_label) AS correct_to_incorrect,
  count(*) FILTER (pred_a <> true_label AND pred_b = true_label) AS incorrect_to_correct, count(*) FILTER (pred_a <> true_label AND pred_b <> true_label) AS unchanged_wrong, round(avg(conf_b - conf_a), 6) AS mean_delta_confidence,
  count(*) FILTER (pred_a <> true_label AND pred_b = true_label) - count(*) FILTER (pred_a = true_label AND pred_b <> true_label) AS net, round(count(*) FILTER (pred_a <> pred_b) / count(*), 6) AS change_rate"""
_SR = f""", sr AS ({texts.ORACLE["section_replace"]}), x AS (SELECT p.*, sr.own AS original, sr.replaced AS replacement, CASE WHEN sr.own <> sr.replaced THEN 'replaced' ELSE 'unchanged' END AS kind FROM p JOIN sr ON sr.doc_id = p.sample_id)
"""
_HIST = "h AS (SELECT event_type, day(ts) AS epoch, avg(value) AS train_loss, count(*)::DOUBLE AS test_f1 FROM events GROUP BY ALL)\n"
ORACLE = {
    "binary_metrics": with_views(_M + "SELECT run, model_path, n, tp, fp, fn, tn, " + ", ".join(f"round({x}, 6) AS {x}" for x in METRICS) + " FROM m", "predictions"),
    "metric_delta": with_views(_M + "SELECT model_path, " + ", ".join(f"round({p}{x}{s}, 6) AS {p}{x}{s}" for x in METRICS for p, s in (("", "_a"), ("", "_b"), ("delta_", ""))) + " FROM d", "predictions"),
    "headline_findings": with_views(_M + "SELECT arg_max(model_path, f1_a) AS best_base, arg_max(model_path, f1_b) AS best_perturbed, arg_min(model_path, delta_f1) AS largest_drop FROM d", "predictions"),
    "batch_loss": with_views("""x AS (SELECT model_path, -ln(greatest(CASE WHEN true_label = 1 THEN prob1 ELSE 1 - prob1 END, 1e-12)) AS l, (row_number() OVER (PARTITION BY model_path ORDER BY sample_id) - 1) // 32 AS b FROM predictions WHERE run = 'base'),
y AS (SELECT model_path, b, avg(l) AS l FROM x GROUP BY ALL) SELECT model_path, round(avg(l), 6) AS loss, count(*) AS batches FROM y GROUP BY 1""", "predictions"),
    "prediction_stability": with_views(_P + "SELECT model_path, " + _STABLE + " FROM p GROUP BY 1", "predictions"),
    "top_regressions": with_views(_P + ", q AS (SELECT model_path, sample_id, round(conf_b - conf_a, 9) AS delta FROM p WHERE pred_a = true_label AND pred_b <> true_label), r AS (SELECT *, row_number() OVER (PARTITION BY model_path ORDER BY delta, sample_id) AS rank FROM q) SELECT model_path, sample_id, round(delta, 6) AS delta, rank FROM r WHERE rank <= 5", "predictions"),
    "transition_pairs": with_views(_P + _SR + """, q0 AS (SELECT *, unnest(CASE WHEN pred_a = true_label AND pred_b <> true_label THEN ['all', 'regressions'] ELSE ['all'] END) AS scope FROM x WHERE kind = 'replaced'),
q AS (SELECT model_path, scope, original, replacement, count(*) AS pairs FROM q0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model_path, scope ORDER BY pairs DESC, original, replacement) AS rank FROM q) SELECT * FROM r WHERE rank <= 8""", "predictions"),
    "section_stability": with_views(_P + _SR + "SELECT model_path, kind, " + _STABLE + " FROM x GROUP BY 1, 2", "predictions"),
    "history_wide": "WITH " + _HIST + "SELECT event_type, epoch, round(train_loss, 6) AS train_loss, round(test_f1, 6) AS test_f1 FROM h",
    "metric_text": with_views(_M + "SELECT model_path, printf('%+.4f', round(delta_f1, 4)) AS delta_f1 FROM d", "predictions"),
    "common_models": with_views("SELECT model_path FROM predictions WHERE run = 'base' INTERSECT SELECT model_path FROM predictions WHERE run = 'pert'", "predictions"),
    "label_decode": with_views("SELECT sample_id, model_path || '_base' AS model, CASE WHEN predicted_label = 1 THEN 'sarcastic' ELSE 'not sarcastic' END AS decoded FROM predictions WHERE run = 'base'", "predictions"),
    "softmax_argmax": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, list_position(v, list_max(v)) - 1 AS predicted, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS confidence FROM e",
    "vector_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings",
    "epoch_delta": "WITH " + _HIST + "SELECT event_type, epoch, round(train_loss, 6) AS train_loss, round(train_loss - lag(train_loss) OVER (PARTITION BY event_type ORDER BY epoch), 6) AS delta FROM h",
    "epoch_ranking": "WITH " + _HIST + "SELECT event_type, max(epoch) AS epoch, round(arg_max(train_loss, epoch), 6) AS train_loss FROM h GROUP BY 1",
    "history_unpivot": "WITH " + _HIST + "SELECT event_type, epoch, 'train_loss' AS metric, round(train_loss, 6) AS value FROM h UNION ALL SELECT event_type, epoch, 'test_f1', round(test_f1, 6) FROM h",
    "best_trial": "WITH " + _HIST + "SELECT event_type, epoch, round(test_f1, 6) AS test_f1 FROM h ORDER BY test_f1 DESC, event_type, epoch LIMIT 1",
}
