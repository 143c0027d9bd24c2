"""Aggregates over items: moments, motion scores, counts and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moments(df: DataFrame, group: str, value: str, digits: int = 6) -> DataFrame:
    """(group, n, mean, variance, std): population moments from sums and sums of squares, which merge map-side."""
    mean, square = F.avg(value), F.avg(F.col(value) * F.col(value))
    var = square - mean * mean
    return df.groupBy(group).agg(F.count(value).alias("n"), F.round(mean, digits).alias("mean"), F.round(var, digits).alias("variance"), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), digits).alias("std"))


def recommended(groups: DataFrame, digits: int = 5) -> DataFrame:
    """(mean, variance): the plain means of the groups' means and population variances."""
    return groups.agg(F.round(F.avg("mean"), digits).alias("mean"), F.round(F.avg("variance"), digits).alias("variance"))


def amplitude_and_smoothness(df: DataFrame, group: str, order: list, value: str, digits: int = 6) -> DataFrame:
    """(group, amplitude, smoothness): the size of the mean of signed values, and (255 - mean step to every second value) / 255."""
    seq = W.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(seq))).withColumn("_n", F.row_number().over(seq) - 1)
    step = F.avg(F.when(F.col("_n") % 2 == 1, F.col("_d")))
    return rows.groupBy(group).agg(F.round(F.abs(F.avg(value)), digits).alias("amplitude"), F.round((255 - step) / 255, digits).alias("smoothness"))


def metric_detail(scores: DataFrame, metric: str, ident: str, score: str) -> DataFrame:
    """(metric, average_score, num_items, items): the mean over items that have a score, and these items by id. An
    evaluation has few items per metric."""
    items = F.array_sort(F.collect_list(F.struct(F.col(ident).alias("id"), F.col(score).alias("score"))))
    rows = scores.filter(F.col(score).isNotNull())
    return rows.groupBy(metric).agg(F.avg(score).alias("average_score"), F.count(F.lit(1)).alias("num_items"), items.alias("items"))


def frame_mean(frames: DataFrame, item: str, score: str) -> DataFrame:
    """(item, score): the mean of an item's frame scores, which run to ten, as a part of one."""
    return frames.groupBy(item).agg(F.avg(F.col(score) / 10).alias("score"))


def reward_means(rewards: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """One row with the mean of each reward over a batch."""
    return rewards.agg(*(F.round(F.avg(n), digits).alias(n) for n in names))


def outcome_counts(df: DataFrame, **tests: Column) -> DataFrame:
    """One row with the number of rows that each test holds for, and of all."""
    return df.agg(*(F.count_if(t).alias(n) for n, t in tests.items()), F.count(F.lit(1)).alias("total"))


def index_lists(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the distinct values of each key, sorted; for keys with few values, such as steps of a run."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def incomplete_shards(index: DataFrame, files: DataFrame, owner: str, shard: str) -> DataFrame:
    """(owner, expected, found) of owners whose index names other shards than there are files."""
    named = index.groupBy(owner).agg(F.countDistinct(shard).alias("expected"))
    there = index.select(owner, shard).distinct().join(files.select(owner, shard).distinct(), [owner, shard]).groupBy(owner).agg(F.count(F.lit(1)).alias("found"))
    return named.join(there, owner, "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("found <> expected")
