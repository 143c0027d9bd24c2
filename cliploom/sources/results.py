"""Metric result documents and run folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.captions import canonical_metric
from cliploom.functions.scoring import picked_score

RESULT = "metric string, average_score double, average_drift_score double, num_videos bigint, per_video_results array<struct<id:bigint,video_name:string,prompt:string>>"


def read_results(spark: SparkSession, pattern: str, valid: list[str] | None = None) -> DataFrame:
    """(model, metric, average_score, average_drift_score, num_videos, items, unreadable): one row per *_results.json.

    The metric is the file's name, the model its folder. Documents of metrics that are not ``valid`` fall out; unreadable
    ones stay, with nulls and unreadable = true, to be reported instead of lost.
    """
    raw = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", RESULT + ", _corrupt_record string").alias("r"))
    name = F.regexp_extract("path", r"([^/]*)_results\.json$", 1)
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    out = raw.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("model"), canonical_metric(name).alias("metric"), "r.average_score", "r.average_drift_score", "r.num_videos", F.col("r.per_video_results").alias("items"), bad.alias("unreadable"))
    return out if valid is None else out.filter(F.col("metric").isin(valid))


MERGED = "map<string, struct<raw_score:double,normalized_score:double,rating:double>>"


def read_merged(spark: SparkSession, pattern: str, score: str = "normalized") -> DataFrame:
    """(model, metric, score) of the merged_results.json in each model's folder that ``pattern`` finds, with the total under
    total_weighted_rating. score: raw, normalized or rating; another name means normalized. Unreadable documents and folders
    without one have no rows."""
    field = {"raw": "raw_score", "rating": "rating"}.get(score, "normalized_score")
    raw = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)/[^/]*$", 1).alias("model"), F.from_json("value", f"summary struct<non_drifting:{MERGED},drifting:{MERGED},total_weighted_rating:double>").alias("d"))
    parts = [F.transform(F.map_entries(F.coalesce(F.col(f"d.summary.{g}"), F.create_map().cast(MERGED))), lambda e: F.struct(e["key"].alias("metric"), e["value"][field].alias("score"))) for g in ("non_drifting", "drifting")]
    total = F.filter(F.array(F.struct(F.lit("total_weighted_rating").alias("metric"), F.col("d.summary.total_weighted_rating").alias("score"))), lambda e: e["score"].isNotNull())
    return raw.filter("d.summary is not null").select("model", F.inline(F.concat(*parts, total)))


def metric_facts(results: DataFrame, compat: bool = False) -> DataFrame:
    """(model, metric, average_score, num_items) for the leaderboard, from readable results."""
    score = picked_score(F.col("average_score"), F.col("average_drift_score"), compat)
    return results.filter(~F.col("unreadable")).select("model", "metric", score.alias("average_score"), F.col("num_videos").alias("num_items")).filter("average_score is not null")


def merged_document(ratings: DataFrame, totals: DataFrame) -> DataFrame:
    """(model, document): each model's metrics by drift and other ones, and its total, as JSON."""
    entry = F.struct(F.col("average_score").alias("raw"), "normalized", "rating")
    pair = F.struct("metric", entry.alias("e"))
    drifting = F.col("metric").startswith("drifting_")
    as_map = lambda test: F.map_from_entries(F.array_sort(F.collect_list(F.when(test, pair))))  # noqa: E731  a model has few metrics
    docs = ratings.groupBy("model").agg(as_map(~drifting).alias("non_drifting"), as_map(drifting).alias("drifting"))
    return docs.join(totals.select("model", "total_rating"), "model", "left").select("model", F.to_json(F.struct("non_drifting", "drifting", "total_rating")).alias("document"))
