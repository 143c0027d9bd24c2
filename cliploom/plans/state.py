"""Queries on stateful sequences, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.vectors import as_text
from cliploom.operators import state, windows
from cliploom.plans.windows import QUERIES as WINDOWS
from cliploom.session import fresh_path, table
from cliploom.streaming import state as streams


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.full_chunks(windows.numbered(table(spark, sf_dir, "events"), "user_id", ["event_id"]), "user_id", "rn", 9)
    return rows.groupBy("user_id", "chunk").agg(F.round(F.avg("value") / 40, 6).alias("mean"), F.round(F.var_samp("value") / 400, 6).alias("variance"))


def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.moving_average(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.9).select("user_id", "event_id", F.round(F.col("ema") + 1e-9, 5).alias("ema"))


def drift_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.drift_flags(_chunks(spark, sf_dir), "user_id", "chunk", "mean", "variance")


def drift_flags_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.drift_flags(_chunks(spark, sf_dir), "user_id", "chunk", "mean", "variance", compat=True)


def fifo_buffer_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.newest(table(spark, sf_dir, "events"), "user_id", [F.desc("event_id")], 20).select("user_id", "event_id")


def similarity_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.similarity_buffer(table(spark, sf_dir, "embeddings"), "label", "vec_id", "vec_id", "embedding", 10)


def buffer_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.buffer_pick(table(spark, sf_dir, "events"), "event_type", "event_id", 4)


def error_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "latent_sample").select("sample_id", *state.error_masks(F.col("sample_id"), 0.9, 0.5, 0.3, 0.2))


def warmup_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = state.admitted(F.col("user_id") % 8, F.col("event_id"), 3, 1000, F.col("event_type") == "view", F.col("event_id"), 0.25)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(ok).alias("admitted"), F.count(F.lit(1)).alias("events"))


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.event_windows(streams.read_table(spark, sf_dir, "events")), fresh_path(spark, "windows"), "complete")


def stream_drift_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift flags of ``drift_flags`` by keyed state, from a stream of the same chunks."""
    source = fresh_path(spark, "chunks")
    _chunks(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("chunk").alias("place"), "mean", "variance").write.parquet(source)
    stream = spark.readStream.schema("key string, place bigint, mean double, variance double").parquet(source)
    out = streams.drained(streams.drift_flags(stream), fresh_path(spark, "flags"))
    return out.select(F.col("key").cast("bigint").alias("user_id"), F.col("place").alias("chunk"), "drift")


def stream_history_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history and target windows of ``history_target_window`` by keyed state, from the events as a stream."""
    events = streams.read_table(spark, sf_dir, "events").filter("value is not null").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("place"), "value")
    out = streams.drained(streams.history_target(events), fresh_path(spark, "histories"))
    return out.select(F.col("key").cast("bigint").alias("user_id"), "chunk", as_text(F.col("history")).alias("history"), as_text(F.col("target")).alias("target"))


_CH = """
WITH RECURSIVE n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS m FROM events),
c AS (SELECT user_id, rn // 9 AS chunk, round(avg(value) / 40, 6) AS mean, round(var_samp(value) / 400, 6) AS variance FROM n WHERE rn // 9 < m // 9 GROUP BY 1, 2),
g AS (SELECT user_id, chunk, mean, variance, mean AS gm, variance AS gv, CAST(NULL AS DOUBLE) AS pm, CAST(NULL AS DOUBLE) AS pv FROM c WHERE chunk = 0
  UNION ALL SELECT c.user_id, c.chunk, c.mean, c.variance, 0.9::DOUBLE * g.gm + 0.1::DOUBLE * c.mean, 0.9::DOUBLE * g.gv + 0.1::DOUBLE * c.variance, g.gm, g.gv FROM g JOIN c ON c.user_id = g.user_id AND c.chunk = g.chunk + 1)
"""
_FLAGS = _CH + "SELECT user_id, chunk, coalesce(abs(mean - pm) > 0.15::DOUBLE AND abs(variance - pv) > 0.15::DOUBLE, false) AS drift FROM g"
_CHANCE = "CAST(('0x' || left(md5({} || ':{}:0'), 8)) AS BIGINT) / 4294967296.0::DOUBLE < {}::DOUBLE"
_CLEAN = _CHANCE.format("sample_id", "mask-clean", 0.2)

HISTORY_SQL = WINDOWS["history_target_window"][1]

QUERIES = {
    "ema_fold": (ema_fold, """
WITH RECURSIVE n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, event_id, rn, value AS ema FROM n WHERE rn = 1 UNION ALL SELECT n.user_id, n.event_id, n.rn, 0.9::DOUBLE * g.ema + (1 - 0.9::DOUBLE) * n.value FROM g JOIN n ON n.user_id = g.user_id AND n.rn = g.rn + 1)
SELECT user_id, event_id, round(ema + 1e-9::DOUBLE, 5) AS ema FROM g"""),
    "drift_flags": (drift_flags, _FLAGS),
    "drift_flags_compat": (drift_flags_compat, _CH + "SELECT user_id, chunk, abs(mean - gm) > 0.15::DOUBLE AND abs(variance - gv) > 0.15::DOUBLE AS drift FROM g"),
    "fifo_buffer_last_n": (fifo_buffer_last_n, "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20"),
    "similarity_buffer": (similarity_buffer, None),
    "buffer_pick": (buffer_pick, "SELECT event_type, arg_min(event_id, (md5(event_id || ':4:0'), event_id)) AS event_id FROM events GROUP BY 1"),
    "error_masks": (error_masks, "SELECT sample_id, " + ", ".join(f"{_CHANCE.format('sample_id', 'mask-' + n, p)} AND NOT ({_CLEAN}) AS {n}" for n, p in (("latent", 0.9), ("noise", 0.5), ("target", 0.3))) + f", {_CLEAN} AS clean FROM latent_sample"),
    "warmup_admission": (warmup_admission, f"SELECT event_type, count(*) FILTER ((event_id < 1000 OR user_id % 8 = 3) AND (event_type <> 'view' OR {_CHANCE.format('event_id', 'admit', 0.25)})) AS admitted, count(*) AS events FROM events GROUP BY 1"),
    "stream_event_windows": (stream_event_windows, "SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "stream_drift_flags": (stream_drift_flags, _FLAGS),
    "stream_history_target": (stream_history_target, HISTORY_SQL),
}
