"""From per-item scores to a leaderboard: means, normalisation, ratings, weighted composite and pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.functions import dims
from cliploom.functions.scoring import normalized, rating


def metric_means(scores: DataFrame, digits: int = 6) -> DataFrame:
    """(model, metric, average_score, num_items) of (model, metric, item_id, score); failed (null) items are left out.

    Means are rounded so that ratings do not depend on the order of summation.
    """
    return scores.filter("score is not null").groupBy("model", "metric").agg(F.round(F.avg("score"), digits).alias("average_score"), F.count(F.lit(1)).alias("num_items"))


def rated(means: DataFrame, is_long: bool = False) -> DataFrame:
    """Adds normalized, rating and weight by metric; metrics without a rule fall out."""
    rules = dims.rules(means.sparkSession, is_long)
    out = means.join(F.broadcast(rules), "metric").withColumn("normalized", normalized(F.col("average_score")))
    return out.withColumn("rating", rating(F.col("normalized"), F.col("kind"), F.col("thresholds"))).drop("kind", "thresholds")


def composite(ratings: DataFrame) -> DataFrame:
    """(model, total_rating, metrics): the weighted sum over the metrics that are there; missing ones are not made up for."""
    return ratings.filter("rating is not null").groupBy("model").agg(F.round(F.sum(F.col("rating") * F.col("weight")), 4).alias("total_rating"), F.count(F.lit(1)).alias("metrics"))


def pivoted(ratings: DataFrame, totals: DataFrame, metrics: list[str], value: str = "rating") -> DataFrame:
    """One row per model, a column per metric in the given order, and the total. The metric list is fixed, so the pivot
    needs no pass to find its columns."""
    wide = ratings.groupBy("model").pivot("metric", metrics).agg(F.first(value))
    return wide.join(totals.select("model", "total_rating"), "model", "left")


def speed_ranking(runs: DataFrame) -> DataFrame:
    """(config, runs, avg_s, min_s, max_s, std_s, rank, speedup) of (config, seconds): speed against the slowest; configs
    whose runs all failed (null) stay, without a rank."""
    stats = runs.groupBy("config").agg(F.count("seconds").alias("runs"), *(F.round(f("seconds"), 6).alias(n) for n, f in (("avg_s", F.avg), ("min_s", F.min), ("max_s", F.max), ("std_s", F.stddev_pop))))
    order = W.partitionBy(F.col("avg_s").isNull()).orderBy("avg_s", "config")  # one row per configuration
    slowest = F.max("avg_s").over(W.partitionBy(F.lit(0)))
    return stats.withColumn("rank", F.when(F.col("avg_s").isNotNull(), F.row_number().over(order))).withColumn("speedup", F.round(F.try_divide(slowest, F.col("avg_s")), 4))
