"""Queries on documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.captions import escaped
from cliploom.operators import leaderboard
from cliploom.plans.scoring import _scores
from cliploom.session import table
from cliploom.sources import manifests, results


def merged_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = leaderboard.rated(leaderboard.metric_means(_scores(spark, sf_dir)))
    return results.merged_document(ratings, leaderboard.composite(ratings))


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest records as received, read and derived; unreadable lines fall out here and are counted elsewhere."""
    rows = manifests.derived(manifests.read_manifest_lines(table(spark, sf_dir, "manifest_raw")).filter("path is not null"))
    return rows.select("raw_id", "num_frame", "height", "width", "fps", "video_path", F.size("cap").alias("captions"))


def validation_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run outputs named by step and index, built from orders, and read back from their names."""
    name = F.format_string("out/global_step%d_%s_video_%d_%s.mp4", F.col("o_custkey"), F.when(F.col("o_orderstatus") == "F", "final_step_validation").otherwise("validation"), F.col("o_orderkey"), F.replace(F.lower("o_orderpriority"), F.lit("-"), F.lit("_")))
    return manifests.validation_videos(table(spark, sf_dir, "orders").select(name.alias("path"))).drop("path")


def checkpoint_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("o_orderstatus") == "F", "checkpoint-").otherwise("ablation_a"), "o_custkey", F.lit("_"), "o_orderkey", F.lit(".mp4"))
    return manifests.checkpoint_videos(table(spark, sf_dir, "orders").select(name.alias("path"))).drop("path")


def evaluation_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.evaluation_videos(table(spark, sf_dir, "toy_filter").select("clip_id", "path"))
    return rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("files"))


def action_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("root/Keys_"), F.replace("action_keys", F.lit("+"), F.lit("_")), F.lit("_Mouse_·/"), "video", F.lit("_frames_"), "start_frame", F.lit("-"), "end_frame", F.lit(".mp4"))
    return manifests.action_files(table(spark, sf_dir, "action_segments").select(path.alias("path")))


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(escaped(F.col(c).cast("string")), F.lit("")), F.lit("</td>"))
    return table(spark, sf_dir, "eval_prompt").select("id", F.concat(F.lit("<tr>"), cell("id"), cell("prompt"), cell("split"), F.lit("</tr>")).alias("row"))


_D = r"WITH j AS (SELECT raw_id, TRY_CAST(regexp_replace(line, '^[\s,]+|[\s,]+$', '', 'g') AS JSON) AS j FROM manifest_raw WHERE json_valid(regexp_replace(line, '^[\s,]+|[\s,]+$', '', 'g')))"

QUERIES = {
    "merged_document": (merged_document, None),
    "manifest_lines": (manifest_lines, _D + """, r AS (SELECT raw_id, from_json(j, '{"cut": ["INTEGER"], "crop": ["INTEGER"], "fps": "DOUBLE", "cap": ["VARCHAR"], "path": "VARCHAR"}') AS r FROM j)
SELECT raw_id, r.cut[2] - r.cut[1] AS num_frame, r.crop[4] - r.crop[3] AS height, r.crop[2] - r.crop[1] AS width, r.fps AS fps,
  replace(replace(replace(r.path, 'videos_clip_v1/', ''), './', ''), 'videos/', '') AS video_path, CAST(len(r.cap) AS INTEGER) AS captions FROM r WHERE r.path IS NOT NULL"""),
    "validation_videos": (validation_videos, "SELECT o_custkey AS step, CASE WHEN o_orderstatus = 'F' THEN 'final_step_validation' ELSE 'validation' END AS kind, o_orderkey AS idx, translate(replace(lower(o_orderpriority), '-', '_'), '_', ' ') AS slug FROM orders"),
    "checkpoint_videos": (checkpoint_videos, "SELECT o_custkey AS step, o_orderkey AS idx FROM orders"),
    "evaluation_videos": (evaluation_videos, r"WITH f AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS f FROM toy_filter) SELECT CAST(regexp_extract(f, '^([0-9]+)_', 1) AS BIGINT) AS video_id, count(*) AS files FROM f WHERE regexp_matches(f, '^[0-9]+_[^/]*_ori[^/]*\.mp4$') GROUP BY 1"),
    "action_files": (action_files, "SELECT video, start_frame, end_frame, action_keys AS keys, '·' AS mouse FROM action_segments WHERE video IS NOT NULL AND action_keys IS NOT NULL AND start_frame IS NOT NULL AND end_frame IS NOT NULL"),
    "html_rows": (html_rows, """
SELECT id, '<tr><td>' || id || '</td><td>' || coalesce(replace(replace(replace(prompt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '') || '</td><td>' || coalesce(split, '') || '</td></tr>' AS row FROM eval_prompt"""),
}
