"""Spark-native analytics for news text: link matching, page extraction, text
features, graph features, perturbation, evaluation and resumable enrichment.

Every operator takes and returns DataFrames and stays lazy."""
