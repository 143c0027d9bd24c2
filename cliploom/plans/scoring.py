"""Queries on metric scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.functions import dims, scoring
from cliploom.operators import leaderboard
from cliploom.session import table

#: Which metric each type of event stands for in the test data.
_METRIC_OF = {"view": "aesthetic", "click": "motion_amplitude", "signup": "motion_smoothness", "purchase": "semantic", "error": "naturalness"}


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in _METRIC_OF.items() for x in kv))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("model"), names[F.col("event_type")].alias("metric"), F.col("event_id").alias("item_id"), (F.col("value") / 40).alias("score"))


_SQL = f"""
WITH names(event_type, metric) AS ({dims.sql_values(list(_METRIC_OF.items()))}),
rules(metric, weight, kind, thresholds) AS ({dims.sql_values([(m, w, *dims.ladder(m, False)) for m, w in dims.WEIGHTS_SHORT.items()])}),
scores AS (SELECT user_id % 5 AS model, metric, event_id AS item_id, value / 40 AS score FROM events JOIN names USING (event_type)),
means AS (SELECT model, metric, round(avg(score), 6) AS average_score, count(*) AS num_items FROM scores WHERE score IS NOT NULL GROUP BY 1, 2),
norm AS (SELECT *, least(1.0, greatest(0.0, average_score)) AS normalized FROM means JOIN rules USING (metric)),
rated AS (SELECT *, coalesce(11 - list_min(list_transform(list_filter(list_zip(thresholds, range(1, 10)), lambda t: normalized >= t[1]), lambda t: t[2])), 1) AS rating FROM norm),
totals AS (SELECT model, round(sum(rating * weight), 4) AS total_rating, count(*) AS metrics FROM rated GROUP BY 1)
"""


def metric_avg_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.metric_means(_scores(spark, sf_dir))


def rating_ladder_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.rated(metric_avg_detail(spark, sf_dir)).select("model", "metric", "normalized", F.col("rating").cast("int").alias("rating"))


def weighted_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.composite(leaderboard.rated(metric_avg_detail(spark, sf_dir)))


def leaderboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = leaderboard.rated(metric_avg_detail(spark, sf_dir))
    return leaderboard.pivoted(ratings, leaderboard.composite(ratings), list(dims.WEIGHTS_SHORT))


def rating_ladder_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    drift = F.abs(F.col("l_discount") - F.col("l_tax"))
    kind, thresholds = dims.ladder("drifting_naturalness", True)
    rated = scoring.rating(F.round(drift, 6), F.lit(kind), F.array(*map(F.lit, thresholds)))
    return table(spark, sf_dir, "lineitem").groupBy(rated.alias("rating")).agg(F.count(F.lit(1)).alias("items"))


def score_type_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = leaderboard.rated(metric_avg_detail(spark, sf_dir))
    pick = lambda kind: scoring.chosen_score(kind, F.col("average_score"), F.col("normalized"), F.col("rating"))
    return ratings.select("model", "metric", pick("raw").alias("raw"), pick("rating").alias("rating"), pick("other").alias("fallback"))


def throughput_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "toy_filter").groupBy("fps").agg(F.count(F.lit(1)).alias("clips")).withColumn("score", scoring.throughput_score(F.col("fps")))


def metric_names_total_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metric names that occur, sorted, with the total at the end."""
    names = _scores(spark, sf_dir).select("metric").distinct().unionByName(spark.createDataFrame([("total",)], "metric string"))
    return names.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy((F.col("metric") == "total").cast("int"), "metric")))


def speed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.speed_ranking(table(spark, sf_dir, "events").select(F.col("event_type").alias("config"), F.when(F.col("event_type") != "error", F.col("value")).alias("seconds")))


def naturalness_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise((F.col("value") / 10).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", F.round(scoring.naturalness(raw), 6).alias("score"))
    return rows.filter("score is not null")


def gsb_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "view", "A").when(F.col("event_type") == "click", "B").when(F.col("event_type") == "signup", "same").when(F.col("event_type") == "purchase", "invalid")
    return table(spark, sf_dir, "events").groupBy(scoring.preference_code(label).alias("code")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.coalesce(F.nullif(F.col("value"), F.lit(0.0)), F.lit(0.0))), 6).alias("mos"))


def drift_score_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain average or else drift average, and what the falsy-zero reading would give."""
    average = F.when(F.col("l_discount") != 0.05, F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").select(scoring.picked_score(average, F.col("l_tax")).alias("s"), scoring.picked_score(average, F.col("l_tax"), compat=True).alias("c"))
    return rows.groupBy("s", "c").agg(F.count(F.lit(1)).alias("items"))


def percent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", scoring.percent(F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 4)).alias("share"))


def reward_znorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = [scoring.z_score(F.col(c), m, s) for c, m, s in (("l_quantity", 25.5, 14.4), ("l_discount", 0.05, 0.03), ("l_tax", 0.04, 0.025))]
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", z[0].alias("vq"), z[1].alias("mq"), z[2].alias("ta")).withColumn("overall", F.col("vq") + F.col("mq") + F.col("ta"))
    return rows.groupBy("l_suppkey").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("vq", "mq", "ta", "overall")))


QUERIES = {
    "leaderboard_pivot": (leaderboard_pivot, _SQL + """
SELECT model, max(CASE WHEN metric = 'aesthetic' THEN rating END) AS aesthetic, max(CASE WHEN metric = 'motion_amplitude' THEN rating END) AS motion_amplitude,
  max(CASE WHEN metric = 'motion_smoothness' THEN rating END) AS motion_smoothness, max(CASE WHEN metric = 'semantic' THEN rating END) AS semantic,
  max(CASE WHEN metric = 'naturalness' THEN rating END) AS naturalness, max(total_rating) AS total_rating FROM rated JOIN totals USING (model) GROUP BY model"""),
    "metric_avg_detail": (metric_avg_detail, _SQL + "SELECT * FROM means"),
    "rating_ladder_higher": (rating_ladder_higher, _SQL + "SELECT model, metric, normalized, rating FROM rated"),
    "weighted_composite": (weighted_composite, _SQL + "SELECT * FROM totals"),
    "score_type_select": (score_type_select, _SQL + "SELECT model, metric, average_score AS raw, CAST(rating AS DOUBLE) AS rating, normalized AS fallback FROM rated"),
    "rating_ladder_lower": (rating_ladder_lower, """
WITH d AS (SELECT round(abs(l_discount - l_tax), 6) AS d FROM lineitem)
SELECT CASE WHEN d <= 0.06 THEN 10 WHEN d <= 0.08 THEN 9 WHEN d <= 0.10 THEN 8 WHEN d <= 0.12 THEN 7 WHEN d <= 0.14 THEN 6 WHEN d <= 0.16 THEN 5 WHEN d <= 0.18 THEN 4
  WHEN d <= 0.20 THEN 3 WHEN d <= 0.22 THEN 2 ELSE 1 END AS rating, count(*) AS items FROM d GROUP BY 1"""),
    "throughput_rating": (throughput_rating, "SELECT fps, count(*) AS clips, CAST(least(10, greatest(1, ceil(fps / 3.2::DOUBLE))) AS INTEGER) AS score FROM toy_filter GROUP BY fps"),
    "metric_names_total_last": (metric_names_total_last, _SQL + ", names_all AS (SELECT DISTINCT metric FROM scores UNION ALL SELECT 'total') SELECT metric, CAST(row_number() OVER (ORDER BY metric = 'total', metric) AS INTEGER) AS position FROM names_all"),
    "speed_ranking": (speed_ranking, """
WITH s AS (SELECT event_type AS config, count(CASE WHEN event_type <> 'error' THEN value END) AS runs, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS avg_s,
  round(min(CASE WHEN event_type <> 'error' THEN value END), 6) AS min_s, round(max(CASE WHEN event_type <> 'error' THEN value END), 6) AS max_s, round(stddev_pop(CASE WHEN event_type <> 'error' THEN value END), 6) AS std_s
  FROM events GROUP BY 1)
SELECT *, CAST(CASE WHEN avg_s IS NOT NULL THEN row_number() OVER (PARTITION BY avg_s IS NULL ORDER BY avg_s, config) END AS INTEGER) AS rank, round(max(avg_s) OVER () / avg_s, 4) AS speedup FROM s"""),
    "naturalness_parse": (naturalness_parse, "SELECT event_id, round((least(5.0, greatest(1.0, value / 10)) - 1) / 4, 6) AS score FROM events WHERE event_type <> 'error' AND value IS NOT NULL"),
    "gsb_labels": (gsb_labels, "SELECT CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 WHEN 'signup' THEN 0 ELSE 22 END AS code, count(*) AS pairs, round(avg(coalesce(value, 0)), 6) AS mos FROM events GROUP BY 1"),
    "drift_score_pick": (drift_score_pick, """
WITH a AS (SELECT CASE WHEN l_discount <> 0.05::DOUBLE THEN l_discount END AS a, l_tax AS t FROM lineitem)
SELECT coalesce(a, t) AS s, coalesce(nullif(a, 0), t) AS c, count(*) AS items FROM a GROUP BY 1, 2"""),
    "percent_format": (percent_format, "SELECT event_type, printf('%.2f%%', round(count(*) / sum(count(*)) OVER (), 4) * 100) AS share FROM events GROUP BY 1"),
    "reward_znorm": (reward_znorm, """
WITH z AS (SELECT l_suppkey, (l_quantity - 25.5) / 14.4::DOUBLE AS vq, (l_discount - 0.05::DOUBLE) / 0.03::DOUBLE AS mq, (l_tax - 0.04::DOUBLE) / 0.025::DOUBLE AS ta FROM lineitem)
SELECT l_suppkey, round(avg(vq), 6) AS vq, round(avg(mq), 6) AS mq, round(avg(ta), 6) AS ta, round(avg(vq + mq + ta), 6) AS overall FROM z GROUP BY 1"""),
}
