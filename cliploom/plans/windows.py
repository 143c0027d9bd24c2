"""Queries on sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.functions.vectors import as_text, lerp
from cliploom.operators import windows
from cliploom.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def history_target_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.history_target(_events(spark, sf_dir), "user_id", "event_id", "value")
    return rows.select("user_id", "chunk", as_text(F.col("history")).alias("history"), as_text(F.col("target")).alias("target"))


def history_three_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.history_target(_events(spark, sf_dir), "user_id", "event_id", "value")
    long, mid, short = windows.split_history(F.col("history"))
    return rows.select("user_id", "chunk", as_text(long).alias("long"), as_text(mid).alias("mid"), as_text(short).alias("short"))


def history_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.history_target(_events(spark, sf_dir), "user_id", "event_id", "value")
    return rows.select("user_id", "chunk", as_text(windows.history_dropout(F.col("history"), 1)).alias("kept_1"), as_text(windows.history_dropout(F.col("history"), 0)).alias("kept_0"))


def count_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.full_chunks(windows.numbered(_events(spark, sf_dir), "user_id", ["event_id"]), "user_id", "rn", 33)
    return rows.groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.round(F.avg("value"), 6).alias("mean"))


def section_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "toy_filter").groupBy("num_frames").agg(F.count(F.lit(1)).alias("clips")).filter("num_frames is not null").withColumn("sections", windows.sections(F.col("num_frames")))


def start_end_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.start_end_drift(_events(spark, sf_dir), "user_id", ["event_id"], "value", least=4)
    return d.select("user_id", *(F.round(c, 6).alias(c) for c in ("start_mean", "end_mean", "drift")))


def pair_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.pair_differences(_events(spark, sf_dir), "user_id", ["event_id"], "value")
    return d.groupBy("user_id").agg(F.round(F.avg("diff"), 6).alias("mean_diff"), F.count("diff").alias("pairs"))


def group_break_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.group_breaks(_events(spark, sf_dir), "user_id", ["event_id"], "event_type").select("event_id", "breaks")


def prev_next_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.neighbours(table(spark, sf_dir, "action_segments"), "video", ["start_frame", "seg_id"], "seg_id").select("seg_id", "previous", "next")


def latest_n_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.newest(table(spark, sf_dir, "latent_sample"), "file_path", [F.desc("listed_at"), F.desc("sample_id")], 1).select("sample_id", "file_path")


def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("checkpoint-"), F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "-final").otherwise("")).alias("name"))
    return windows.latest_checkpoint(names, "o_custkey", "name")


def cumulative_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of each order's lines on the running total of their quantities."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("length")).groupBy("l_orderkey", "l_linenumber").agg(F.sum("length").alias("length"))
    return windows.schedule(lines, "l_orderkey", "l_linenumber", "length")


def _lerp_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = v.withColumn("p", F.lag("v").over(W.partitionBy("label").orderBy("vec_id"))).filter("p is not null")
    return rows.select("vec_id", "v", "p", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("step"))


def interval_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's first steps on the way from the vector before it of its label."""
    return _lerp_steps(spark, sf_dir).select("vec_id", "step", as_text(lerp(F.col("p"), F.col("v"), F.col("step") / 2)).alias("vector"))


def stride_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", as_text(windows.every_second(F.col("v"), 1)).alias("odd"))


def worker_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.numbered(_events(spark, sf_dir), "user_id", ["event_id"]).withColumn("m", F.count(F.lit(1)).over(W.partitionBy("user_id")))
    return rows.withColumn("worker", windows.worker_of(F.col("rn"), F.col("m"), 8)).groupBy("user_id", "worker").agg(F.min("rn").cast("bigint").alias("first"), F.max("rn").cast("bigint").alias("last"))


_T = "array_to_string(list_transform({}, lambda x: printf('%.6f', x)), ',')"
_HT = """
WITH r AS (SELECT user_id, row_number() OVER w - 1 AS n, list(value) OVER (w ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS h, list(value) OVER (w ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT user_id, n // 9 AS chunk, list_concat(list_transform(range(0, 19 - coalesce(len(h), 0)), lambda i: 0.0::DOUBLE), coalesce(h, [])) AS h, t FROM r WHERE n % 9 = 0 AND len(t) = 9)
"""
_RN = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS m FROM events)"

QUERIES = {
    "history_target_window": (history_target_window, _HT + f"SELECT user_id, chunk, {_T.format('h')} AS history, {_T.format('t')} AS target FROM c"),
    "history_three_level": (history_three_level, _HT + f"SELECT user_id, chunk, {_T.format('h[1:16]')} AS long, {_T.format('h[17:18]')} AS mid, {_T.format('h[19:19]')} AS short FROM c"),
    "history_dropout": (history_dropout, _HT + f"SELECT user_id, chunk, {_T.format('list_transform(h, lambda x, i: CASE WHEN i <= 18 THEN 0.0 ELSE x END)')} AS kept_1, {_T.format('list_transform(h, lambda x: 0.0)')} AS kept_0 FROM c"),
    "count_chunking": (count_chunking, _RN + " SELECT user_id, rn // 33 AS chunk, count(*) AS events, min(event_id) AS first_event, round(avg(value), 6) AS mean FROM r WHERE rn // 33 < m // 33 GROUP BY 1, 2"),
    "section_count": (section_count, "SELECT num_frames, count(*) AS clips, CAST(greatest(1, ceil(num_frames / 33)) AS INTEGER) AS sections FROM toy_filter WHERE num_frames IS NOT NULL GROUP BY 1"),
    "start_end_drift": (start_end_drift, _RN + """, d AS (SELECT user_id, avg(CASE WHEN rn < greatest(4, floor(m * 0.15::DOUBLE)) THEN value END) AS s, avg(CASE WHEN rn >= m - greatest(4, floor(m * 0.15::DOUBLE)) THEN value END) AS e FROM r GROUP BY 1)
SELECT user_id, round(s, 6) AS start_mean, round(e, 6) AS end_mean, round(abs(s - e), 6) AS drift FROM d"""),
    "pair_diff": (pair_diff, "WITH d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events) SELECT user_id, round(avg(d), 6) AS mean_diff, count(d) AS pairs FROM d GROUP BY 1"),
    "group_break_flag": (group_break_flag, "SELECT event_id, row_number() OVER w = 1 OR lag(event_type) OVER w IS DISTINCT FROM event_type AS breaks FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "prev_next_clamped": (prev_next_clamped, "SELECT seg_id, coalesce(lag(seg_id) OVER w, seg_id) AS previous, coalesce(lead(seg_id) OVER w, seg_id) AS next FROM action_segments WINDOW w AS (PARTITION BY video ORDER BY start_frame NULLS FIRST, seg_id)"),
    "latest_n_retention": (latest_n_retention, "SELECT sample_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY listed_at DESC NULLS LAST, sample_id DESC) AS r FROM latent_sample) WHERE r = 1"),
    "latest_checkpoint": (latest_checkpoint, "SELECT o_custkey, arg_max('checkpoint-' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '-final' ELSE '' END, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderkey)) AS latest FROM orders GROUP BY 1"),
    "cumulative_schedule": (cumulative_schedule, """
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS length FROM lineitem GROUP BY 1, 2), e AS (SELECT *, CAST(sum(length) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS ends FROM l)
SELECT *, ends - length AS begins FROM e"""),
    "interval_lerp": (interval_lerp, f"""
WITH v AS (SELECT vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT vec_id, CAST(step AS INTEGER) AS step, {_T.format('list_transform(range(1, len(v) + 1), lambda i: CAST(p[i] AS DOUBLE) * (1 - step / 2) + CAST(v[i] AS DOUBLE) * (step / 2))')} AS vector FROM v, range(0, 3) s(step) WHERE p IS NOT NULL"""),
    "stride_two": (stride_two, f"SELECT vec_id, {_T.format('list_transform(range(1, len(embedding) // 2 + 1), lambda i: CAST(embedding[2 * i] AS DOUBLE))')} AS odd FROM embeddings"),
    "worker_ranges": (worker_ranges, _RN + " SELECT user_id, CAST(floor(rn / ceil(m / 8)) AS INTEGER) AS worker, min(rn) AS first, max(rn) AS last FROM r GROUP BY 1, 2"),
}
