"""Queries on set operations, run comparison and document differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import captions, shapes
from cliploom.operators import aggregates, compare
from cliploom.session import table


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outputs of runs: the status is the run, (customer, month) its (step, idx)."""
    return table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_custkey").alias("step"), F.month("o_orderdate").alias("idx"))


def run_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    return compare.common_keys(r.filter("o_orderstatus = 'O'"), r.filter("o_orderstatus = 'F'"), "step", "idx")


def run_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    return compare.only_in_first(r.filter("o_orderstatus = 'O'"), r.filter("o_orderstatus = 'F'"), "step", "idx")


def same_idx_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.first_two_steps(table(spark, sf_dir, "action_segments"), "video", "start_frame")


def index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.index_lists(_runs(spark, sf_dir), "step", "idx").select("step", F.array_join("values", ",").alias("idxs"))


def key_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between customers' order totals of two statuses."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_custkey").alias("path")).agg(F.count(F.lit(1)).alias("value"))
    d = compare.differences(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"))
    return d.select(F.col("path").alias("custkey"), "left", "right", "kind")


def config_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of repeated configurations of a stage that differ from the stage's first one, those ignored left out."""
    c = table(spark, sf_dir, "data_config").withColumn("stage", F.regexp_extract("config_name", r"^(stage_\d+)", 1))
    fields = F.array(*(F.struct(F.lit(n).alias("f"), v.cast("string").alias("value")) for n, v in (("max_repeats", F.col("max_repeats")), ("epoch_frames", F.col("epoch_frames")), ("roots", F.size("instance_data_root")))))
    flat = c.select("config_id", "stage", F.explode(fields).alias("e")).select("config_id", "stage", "e.f", "e.value")
    first = flat.groupBy("stage", "f").agg(F.min_by("value", "config_id").alias("base"))
    left = flat.select(F.concat_ws(".", "stage", F.col("config_id").cast("string"), "f").alias("path"), "value")
    right = flat.join(first, ["stage", "f"]).select(F.concat_ws(".", "stage", F.col("config_id").cast("string"), "f").alias("path"), F.col("base").alias("value"))
    return compare.without_ignored(compare.differences(left, right), ["roots"])


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eval_prompt").select("id", "prompt", "duration")
    p = table(spark, sf_dir, "prompt_table").select(F.col("prompt_id").alias("id"), "prompt", "action_class")
    return compare.all_by_name(e, p)


def union_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "toy_filter").select(shapes.stem(F.col("path")).alias("video"))
    return clips.union(table(spark, sf_dir, "action_segments").select("video")).distinct().filter("video is not null")


def tolerance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select(F.round(F.col("p_retailprice") / 7, 3).alias("t")).distinct()
    targets = table(spark, sf_dir, "part").select(F.round(F.col("p_retailprice") / 7 + 0.02, 3).alias("t")).distinct()
    return compare.tolerant_union(points, targets, "t", 0.01)


def shard_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos whose clips' roots are not all among the roots of its samples."""
    index = table(spark, sf_dir, "toy_filter").filter("dataset_name is not null").select(shapes.stem(F.col("path")).alias("video"), F.regexp_replace("dataset_name", "/+$", "").alias("root"))
    files = table(spark, sf_dir, "latent_sample").filter("dataset_name is not null").select(F.regexp_replace("uttid", r"_\d{7}_\d{7}$", "").alias("video"), F.regexp_replace("dataset_name", "/+$", "").alias("root"))
    return aggregates.incomplete_shards(index, files, "video", "root")


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "prompt_table")
    return aggregates.outcome_counts(p, changed=~F.col("prompt").eqNullSafe(F.col("refined_prompt")), matched=F.col("chunk_actions_json").isNotNull(), missing=F.coalesce(F.trim("prompt"), F.lit("")) == "")


def map_split_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the orders by a key that repeats a prefix, split by key and without the prefix."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    m = o.groupBy("o_custkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("base.base."), F.col("o_orderstatus")).alias("k"), F.col("n"))))).alias("m"))
    part = compare.without_repeated_prefix(compare.entries_where(F.col("m"), lambda k: ~k.endswith("P")), r"base\.")
    text = F.array_join(F.transform(F.map_entries(part), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return m.select("o_custkey", text.alias("kept"))


def weight_map_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct shards that keys renamed by prefix rules are in."""
    rules = [("data/clips/", "clips."), ("data/", "other.")]
    rows = table(spark, sf_dir, "latent_sample").filter("dataset_name is not null").select(captions.renamed_prefix(F.regexp_replace("dataset_name", "/+$", ""), rules).alias("key"), F.concat_ws("x", "height", "width").alias("shard"))
    return rows.groupBy("key").agg(F.countDistinct("shard").alias("shards"))


def nested_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media entries of nested configurations: each root with a ratio, with its places."""
    c = table(spark, sf_dir, "data_config").select("config_id", F.posexplode(F.arrays_zip("instance_data_root", "dataset_sampling_ratios")).alias("pos", "e"))
    return c.filter("e.dataset_sampling_ratios > 0").select("config_id", "pos", F.col("e.instance_data_root").alias("root"), F.col("e.dataset_sampling_ratios").alias("ratio"))


_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]+$', '')"
_R = "WITH r AS (SELECT o_orderstatus AS s, o_custkey AS step, CAST(month(o_orderdate) AS INTEGER) AS idx FROM orders)"

QUERIES = {
    "run_intersect": (run_intersect, _R + " SELECT step, idx FROM r WHERE s = 'O' INTERSECT SELECT step, idx FROM r WHERE s = 'F'"),
    "run_except": (run_except, _R + " SELECT step, idx FROM r WHERE s = 'O' EXCEPT SELECT step, idx FROM r WHERE s = 'F'"),
    "same_idx_two_steps": (same_idx_two_steps, "WITH s AS (SELECT video, list_sort(list(DISTINCT start_frame)) AS s FROM action_segments WHERE start_frame IS NOT NULL GROUP BY 1) SELECT video, s[1] AS first, s[2] AS second FROM s WHERE len(s) >= 2"),
    "index_lists": (index_lists, _R + " SELECT step, array_to_string(list_sort(list(DISTINCT idx)), ',') AS idxs FROM r GROUP BY 1"),
    "key_diff_full_outer": (key_diff_full_outer, """
WITH o AS (SELECT o_orderstatus AS s, o_custkey AS k, count(*) AS n FROM orders GROUP BY 1, 2), j AS (SELECT coalesce(a.k, b.k) AS custkey, a.n AS "left", b.n AS "right" FROM (FROM o WHERE s = 'O') a FULL JOIN (FROM o WHERE s = 'F') b ON a.k = b.k)
SELECT *, CASE WHEN "right" IS NULL THEN 'only left' WHEN "left" IS NULL THEN 'only right' ELSE 'differs' END AS kind FROM j WHERE "left" IS DISTINCT FROM "right" """),
    "config_drift": (config_drift, r"""
WITH c AS (SELECT *, regexp_extract(config_name, '^(stage_[0-9]+)', 1) AS stage FROM data_config),
f AS (SELECT config_id, stage, 'max_repeats' AS f, CAST(max_repeats AS VARCHAR) AS v FROM c UNION ALL SELECT config_id, stage, 'epoch_frames', CAST(epoch_frames AS VARCHAR) FROM c),
b AS (SELECT *, first_value(v) OVER (PARTITION BY stage, f ORDER BY config_id) AS base FROM f)
SELECT concat_ws('.', stage, config_id, f) AS path, v AS "left", base AS "right", 'differs' AS kind FROM b WHERE v IS DISTINCT FROM base"""),
    "union_by_name": (union_by_name, "SELECT id, prompt, duration, NULL::VARCHAR AS action_class FROM eval_prompt UNION ALL SELECT prompt_id, prompt, NULL, action_class FROM prompt_table"),
    "union_distinct_keys": (union_distinct_keys, f"SELECT * FROM (SELECT {_STEM} AS video FROM toy_filter UNION SELECT video FROM action_segments) WHERE video IS NOT NULL"),
    "tolerance_union": (tolerance_union, """
WITH p AS (SELECT DISTINCT round(p_retailprice / 7, 3) AS t FROM part), g AS (SELECT DISTINCT round(p_retailprice / 7 + 0.02::DOUBLE, 3) AS t FROM part)
SELECT t FROM p UNION ALL SELECT t FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE abs(g.t - p.t) < 0.01::DOUBLE)"""),
    "shard_completeness": (shard_completeness, rf"""
WITH i AS (SELECT DISTINCT {_STEM} AS video, regexp_replace(dataset_name, '/+$', '') AS root FROM toy_filter WHERE dataset_name IS NOT NULL),
f AS (SELECT DISTINCT regexp_replace(uttid, '_[0-9]{{7}}_[0-9]{{7}}$', '') AS video, regexp_replace(dataset_name, '/+$', '') AS root FROM latent_sample WHERE dataset_name IS NOT NULL)
SELECT i.video, count(DISTINCT i.root) AS expected, count(f.root) AS found FROM i LEFT JOIN f ON i.video = f.video AND i.root = f.root GROUP BY i.video HAVING count(f.root) <> count(DISTINCT i.root)"""),
    "outcome_counts": (outcome_counts, "SELECT count(*) FILTER (prompt IS DISTINCT FROM refined_prompt) AS changed, count(chunk_actions_json) AS matched, count(*) FILTER (coalesce(trim(prompt), '') = '') AS missing, count(*) AS total FROM prompt_table"),
    "map_split_rename": (map_split_rename, "SELECT o_custkey, coalesce(string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) FILTER (o_orderstatus <> 'P'), '') AS kept FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"),
    "weight_map_shards": (weight_map_shards, """
WITH r AS (SELECT regexp_replace(dataset_name, '/+$', '') AS d, concat_ws('x', height, width) AS shard FROM latent_sample WHERE dataset_name IS NOT NULL)
SELECT CASE WHEN starts_with(d, 'data/clips/') THEN 'clips.' || substr(d, 12) WHEN starts_with(d, 'data/') THEN 'other.' || substr(d, 6) ELSE d END AS key, count(DISTINCT shard) AS shards FROM r GROUP BY 1"""),
    "nested_messages": (nested_messages, """
WITH e AS (SELECT config_id, unnest(range(0, len(instance_data_root))) AS pos, instance_data_root AS n, dataset_sampling_ratios AS r FROM data_config)
SELECT config_id, CAST(pos AS INTEGER) AS pos, n[pos + 1] AS root, r[pos + 1] AS ratio FROM e WHERE r[pos + 1] > 0"""),
}
