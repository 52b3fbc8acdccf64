"""Retrieval quality: hit rate, mean reciprocal rank, precision and recall at k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_relevant(key: Column, source: Column, ids: Column, sources: Column) -> Column:
    return F.coalesce(F.array_contains(ids, key), F.lit(False)) | F.coalesce(F.array_contains(sources, source), F.lit(False))


def evaluate_retrieval(results: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """One row: cases, k, hit_rate, mrr, precision_at_k, recall_at_k.

    ``results``: case_id, id, source, rank. ``cases``: case_id, relevant_ids, relevant_sources (arrays
    or null). Precision divides by k; recall goes by ids where a case has any, else by sources. Cases
    without results count with zeros; without cases an error is raised when the row is read.
    """
    joined = cases.join(results.where(F.col("rank") <= k), "case_id", "left")
    rel = is_relevant(F.col("id"), F.col("source"), F.col("relevant_ids"), F.col("relevant_sources")) & F.col("rank").isNotNull()
    by_ids = F.coalesce(F.size("relevant_ids"), F.lit(0)) > 0
    per = joined.groupBy("case_id").agg(
        F.max(rel.cast("double")).alias("hit"),
        F.coalesce(1 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("rr"),
        (F.sum(rel.cast("double")) / k).alias("precision"),
        F.first(by_ids).alias("by_ids"),
        F.first("relevant_ids").alias("ids"),
        F.first("relevant_sources").alias("srcs"),
        F.collect_set("id").alias("got_ids"),
        F.collect_set("source").alias("got_sources"),
    )
    wanted = F.when(F.col("by_ids"), F.array_distinct("ids")).otherwise(F.array_distinct("srcs"))
    got = F.when(F.col("by_ids"), F.col("got_ids")).otherwise(F.col("got_sources"))
    recall = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, got)) / F.size(wanted)).otherwise(F.lit(0.0))
    out = per.withColumn("recall", recall).agg(F.count("*").alias("cases"), F.avg("hit").alias("hit_rate"), F.avg("rr").alias("mrr"), F.avg("precision").alias("precision_at_k"), F.avg("recall").alias("recall_at_k"))
    return out.select(F.when(F.col("cases") == 0, F.raise_error(F.lit("no cases to evaluate")).cast("long")).otherwise(F.col("cases")).alias("cases"), F.lit(k).alias("k"), "hit_rate", "mrr", "precision_at_k", "recall_at_k")
