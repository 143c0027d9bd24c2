"""Queries on histories, intervals, frames, buffers and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.functions import actions, shapes
from cliploom.functions import vectors as v
from cliploom.operators import aggregates, collate, compare, ordering, sampling, state, windows
from cliploom.session import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.doubles(F.col("embedding")).alias("v"))


def history_dropout_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of 19 values with the oldest dropped as for text, image and video input."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.slice("v", 1, 19).alias("h"))
    rows = rows.withColumn("dropped", windows.dropped_entries(F.col("vec_id"), 19, 0.2, 0.3, 0.5))
    return rows.select("vec_id", "dropped", v.as_text(windows.oldest_zeroed(F.col("h"), F.col("dropped")), 5).alias("history"))


def rollout_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of three sections of nine frames of each clip that has them, with its history."""
    clips = table(spark, sf_dir, "toy_filter").select("clip_id", F.floor(F.col("num_frames") / 9).cast("int").alias("n")).filter("n >= 3")
    r = windows.rollout_range(F.col("n"), 3, F.col("clip_id"))
    return clips.select("clip_id", r["start"].alias("start"), r["end"].alias("end"))


def prompt_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt vector of every section of each configuration's schedule: its roots follow each other, each for some
    sections, and blend over the first four."""
    c = table(spark, sf_dir, "data_config").select("config_id", F.posexplode("instance_data_root").alias("pos", "root"))
    c = c.select("config_id", "pos", (F.length("root") % 7 + 1).cast("bigint").alias("length"), ((F.col("config_id") * 10 + F.col("pos")) % 100).alias("vec_id"))
    rows = c.join(_vectors(spark, sf_dir).select("vec_id", "v"), "vec_id")
    return windows.interval_steps(rows, "config_id", "pos", "length", "v", 4).select("config_id", "section", v.as_text(F.col("v"), 5).alias("vector"))


def chunk_action_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action of chunks 0 to 9 of each prompt with a list of actions, the last action going on."""
    rows = table(spark, sf_dir, "prompt_table").select("prompt_id", actions.actions_of_json(F.col("chunk_actions_json")).alias("a")).filter(F.size("a") > 0)
    rows = rows.select("prompt_id", "a", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("chunk"))
    at = actions.chunk_action(F.col("a"), F.col("chunk"))
    return rows.select("prompt_id", "chunk", at["keys"].alias("keys"), at["mouse"].alias("mouse"))


def clip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, f = F.col("num_frames"), F.col("fps")
    return table(spark, sf_dir, "toy_filter").filter("num_frames is not null").select("clip_id", shapes.clip_fps(n, f).alias("rate"), shapes.clip_fps(n, f, compat=True).alias("rate_compat"))


def frame_index_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "toy_filter").filter("num_frames > 0")
    return rows.select("clip_id", F.array_join(shapes.random_frames(16, F.col("num_frames"), F.col("clip_id"), 3), ",").alias("frames"))


def point_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "toy_filter").filter("num_frames > 0 and fps > 0")
    return rows.select("clip_id", F.array_join(shapes.point_frames(F.col("num_frames"), F.col("fps")), ",").alias("frames"))


def sequence_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector after the one before it of its label."""
    rows = _vectors(spark, sf_dir).withColumn("p", F.lag("v").over(W.partitionBy("label").orderBy("vec_id"))).filter("p is not null")
    return rows.select("vec_id", F.size(F.concat("p", "v")).alias("n"), v.as_text(F.concat("p", "v"), 4).alias("joined"))


def metric_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each label's first entries, those below zero having failed, and its items by id."""
    x = F.element_at("v", 1)
    d = aggregates.metric_detail(_vectors(spark, sf_dir).withColumn("s", F.when(x >= 0, x)), "label", "vec_id", "s")
    items = F.array_join(F.transform("items", lambda i: F.format_string("%d:%.5f", i["id"], i["score"])), ",")
    return d.select("label", F.round("average_score", 6).alias("average_score"), "num_items", items.alias("items"))


def frame_mean_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = aggregates.frame_mean(table(spark, sf_dir, "events"), "user_id", "value")
    return d.select("user_id", F.round("score", 6).alias("score"))


def reward_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of three rewards and their sum over all vectors."""
    e = _vectors(spark, sf_dir).select(*(F.element_at("v", i + 1).alias(n) for i, n in enumerate(("VQ", "MQ", "TA"))))
    return aggregates.reward_means(e.withColumn("Overall", F.col("VQ") + F.col("MQ") + F.col("TA")), ["VQ", "MQ", "TA", "Overall"])


def random_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.random_buffer(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id", 20, 6).select("user_id", "slot", "event_id")


def any_buffer_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each evaluation prompt, whatever its type, and the intensity it gets."""
    d = state.any_buffer_pick(table(spark, sf_dir, "eval_prompt"), "id", table(spark, sf_dir, "events"), "event_id", 8)
    return d.select("id", "event_id", F.round(state.intensity(F.col("id"), 0.3), 9).alias("intensity"))


def run_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of two runs for the same step and index side by side: orders of two statuses by customer and month."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_custkey").alias("step"), F.month("o_orderdate").alias("idx"), "o_orderkey")
    return compare.run_pairs(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), ["step", "idx"], "o_orderkey")


def evaluation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each evaluation video in numeric order of its name."""
    from cliploom.sources import manifests

    names = manifests.evaluation_videos(table(spark, sf_dir, "toy_filter").select("clip_id", "path"))
    return ordering.positions(names.groupBy("video_id").agg(F.min("path").alias("path")), [F.col("video_id")], "place").select("video_id", "place")


def same_shape_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample, or for one without a number of frames a whole one of the same shape."""
    s = table(spark, sf_dir, "latent_sample").select("sample_id", F.concat_ws("x", "height", "width").alias("bucket"), "num_frame")
    return sampling.substituted(s, "sample_id", "bucket", F.col("num_frame").isNotNull(), 12)


def remaining_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 200 samples whose root is in no configuration, by hash, in order of their paths."""
    s = table(spark, sf_dir, "latent_sample").select("sample_id", "file_path", F.coalesce("dataset_name", F.lit("")).alias("root"))
    done = table(spark, sf_dir, "prompt_table").select(F.col("prompt_id").alias("sample_id")).filter("sample_id % 2 = 0")
    return sampling.remaining_sample(s, done, "sample_id", ["file_path", "sample_id"], 200, 42).select("sample_id", F.col("position").cast("bigint").alias("position"))


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_prompt").select("id", "split").orderBy("id").limit(100)


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the first 50 distinct videos."""
    p = table(spark, sf_dir, "prompt_table").select("prompt_id", "id")
    return p.join(p.select("id").filter("id is not null").distinct().orderBy("id").limit(50), "id", "left_semi").select("prompt_id", "id")


def collate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in batches of 16 by place, as lists; samples without a number of frames fall out."""
    s = ordering.positions(table(spark, sf_dir, "latent_sample").select("sample_id", "num_frame", "height", "width"), [F.col("sample_id")])
    item = F.when(F.col("num_frame").isNotNull(), F.struct("sample_id", "num_frame", F.struct("height", "width").alias("shape")))
    d = collate.collated(s.select(F.floor(F.col("position") / 16).cast("bigint").alias("batch"), "sample_id", item.alias("item")), "batch", "sample_id", "item")
    return d.select("batch", F.array_join("num_frame", ",").alias("frames"), F.array_join("shape.height", ",").alias("heights"), F.array_join("shape.width", ",").alias("widths"))


def stacked_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in batches of eight of their label, stacked; every second label has vectors cut to different lengths, which
    stay a list."""
    n = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = _vectors(spark, sf_dir).withColumn("batch", F.floor(n / 8).cast("bigint"))
    rows = rows.withColumn("v", F.when(F.col("label") % 2 == 0, F.col("v")).otherwise(F.slice("v", F.lit(1), (F.col("vec_id") % 3 + 1).cast("int"))))
    d = rows.groupBy("label", "batch").agg(collate.in_order("vec_id", "v").alias("a")).withColumn("s", collate.stacked(F.col("a")))
    return d.select("label", "batch", F.size("a").alias("items"), F.col("s.width").alias("width"), v.as_text(F.col("s.values"), 3).alias("stacked"))


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a label merged into one: ids stacked, the first three entries joined, the last entry of the first one."""
    rows = _vectors(spark, sf_dir).select("label", "vec_id", F.slice("v", 1, 3).alias("head"), F.round(F.element_at("v", -1), 6).alias("last"))
    d = collate.merged(rows.withColumn("place", F.col("vec_id")), "label", "place", ["vec_id"], ["head"], ["last"])
    return d.select("label", F.array_join("vec_id", ",").alias("ids"), v.as_text(F.col("head"), 4).alias("head"), "last")


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_TXT = "array_to_string(list_transform({}, lambda x: printf('%.{}f', x)), ',')"
_H = "CAST(('0x' || left(md5({0} || ':{1}:0'), 8)) AS BIGINT)"
_U = _H + " / 4294967296::DOUBLE"


def _by(name: str) -> str:
    return _U.format("vec_id", f"drop-{name}")


QUERIES = {
    "history_dropout_modes": (history_dropout_modes, f"""
WITH {_E}, d AS (SELECT vec_id, v[1:19] AS h, CASE WHEN {_by('text')} <= 0.2::DOUBLE THEN 19 WHEN {_by('image')} <= 0.3::DOUBLE THEN 18 WHEN {_by('video')} <= 0.5::DOUBLE THEN 1 + {_H.format('vec_id', 'drop-windows')} % 3 * 9 ELSE 0 END AS dropped FROM e)
SELECT vec_id, CAST(dropped AS INTEGER) AS dropped, {_TXT.format('list_transform(h, lambda x, i: CASE WHEN i <= dropped THEN 0.0 ELSE x END)', 5)} AS history FROM d"""),
    "rollout_ranges": (rollout_ranges, f"""
WITH c AS (SELECT clip_id, num_frames // 9 AS n FROM toy_filter WHERE num_frames // 9 >= 3), s AS (SELECT clip_id, {_H.format('clip_id', 0)} % (n - 2) * 9 AS a FROM c)
SELECT clip_id, CAST(a AS INTEGER) AS start, CAST(a + 46 AS INTEGER) AS "end" FROM s"""),
    "prompt_intervals": (prompt_intervals, f"""
WITH {_E}, r AS (SELECT config_id, unnest(range(0, len(instance_data_root))) AS pos, unnest(instance_data_root) AS root FROM data_config),
l AS (SELECT config_id, pos, length(root) % 7 + 1 AS n, e.v FROM r JOIN e ON e.vec_id = (config_id * 10 + pos) % 100),
c AS (SELECT *, sum(n) OVER (PARTITION BY config_id ORDER BY pos) AS ends, lag(v) OVER (PARTITION BY config_id ORDER BY pos) AS p FROM l),
s AS (SELECT config_id, CAST(ends - n AS BIGINT) AS b, v, p, unnest(range(CAST(ends - n AS BIGINT), CAST(ends AS BIGINT))) AS section FROM c)
SELECT config_id, section, {_TXT.format('CASE WHEN p IS NOT NULL AND section - b < 4 THEN list_transform(list_zip(p, v), lambda z: z[1] * (1 - (section - b) / 3::DOUBLE) + z[2] * ((section - b) / 3::DOUBLE)) ELSE v END', 5)} AS vector FROM s"""),
    "chunk_action_clamped": (chunk_action_clamped, """
WITH j AS (SELECT prompt_id, CASE WHEN json_valid(chunk_actions_json) THEN from_json(chunk_actions_json, '[{"keys": "VARCHAR", "mouse": "VARCHAR"}]') END AS a FROM prompt_table WHERE chunk_actions_json IS NOT NULL),
c AS (SELECT prompt_id, unnest(range(0, 10)) AS chunk, a FROM j WHERE len(a) > 0)
SELECT prompt_id, CAST(chunk AS INTEGER) AS chunk, coalesce(a[least(chunk + 1, len(a))].keys, 'None') AS keys, coalesce(a[least(chunk + 1, len(a))].mouse, '·') AS mouse FROM c"""),
    "clip_rate": (clip_rate, "SELECT clip_id, CASE WHEN num_frames <= 49 THEN 8 WHEN num_frames <= 93 THEN 16 ELSE fps END AS rate, CASE WHEN num_frames <= 93 THEN 16 ELSE fps END AS rate_compat FROM toy_filter WHERE num_frames IS NOT NULL"),
    "frame_index_random": (frame_index_random, None),
    "point_index": (point_index, """
WITH c AS (SELECT clip_id, num_frames, CAST(floor(num_frames * 8 / fps) AS INTEGER) AS n FROM toy_filter WHERE num_frames > 0 AND fps > 0),
p AS (SELECT *, list_transform(range(0, 4), lambda i: CAST(round_even(3 + i * ((n - 7) / 3::DOUBLE), 0) AS BIGINT)) AS pts FROM c)
SELECT clip_id, CASE WHEN n > 6 THEN array_to_string(flatten(list_transform(pts, lambda p: list_transform(range(p - 3, p + 3), lambda k: CAST(round_even(k * ((num_frames - 1) / (n - 1)::DOUBLE), 0) AS INTEGER)))), ',') END AS frames FROM p"""),
    "sequence_concat": (sequence_concat, f"WITH {_E}, p AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM e) SELECT vec_id, CAST(len(p) + len(v) AS INTEGER) AS n, {_TXT.format('list_concat(p, v)', 4)} AS joined FROM p WHERE p IS NOT NULL"),
    "metric_detail": (metric_detail, f"WITH {_E} SELECT label, round(avg(v[1]), 6) AS average_score, count(*) AS num_items, string_agg(printf('%d:%.5f', vec_id, v[1]), ',' ORDER BY vec_id) AS items FROM e WHERE v[1] >= 0 GROUP BY 1"),
    "frame_mean_tenth": (frame_mean_tenth, "SELECT user_id, round(avg(value / 10), 6) AS score FROM events GROUP BY 1"),
    "reward_means": (reward_means, f'WITH {_E} SELECT round(avg(v[1]), 6) AS "VQ", round(avg(v[2]), 6) AS "MQ", round(avg(v[3]), 6) AS "TA", round(avg(v[1] + v[2] + v[3]), 6) AS "Overall" FROM e'),
    "random_buffer": (random_buffer, f"""
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
s AS (SELECT user_id, event_id, CAST(CASE WHEN n < 20 THEN n ELSE {_H.format('event_id', 6)} % 20 END AS INTEGER) AS slot FROM n) SELECT user_id, slot, max(event_id) AS event_id FROM s GROUP BY 1, 2"""),
    "any_buffer_pick": (any_buffer_pick, f"""
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events), w AS (SELECT id, {_H.format('id', 8)} % (SELECT count(*) FROM events) AS p, round(0.7::DOUBLE + {_U.format('id', 'intensity')} * 0.6::DOUBLE, 9) AS intensity FROM eval_prompt)
SELECT id, event_id, intensity FROM w JOIN p USING (p)"""),
    "run_pairs": (run_pairs, """
WITH r AS (SELECT o_orderstatus AS s, o_custkey AS step, CAST(month(o_orderdate) AS INTEGER) AS idx, o_orderkey AS k FROM orders),
j AS (SELECT a.step, a.idx, a.k AS first, b.k AS second FROM r a JOIN r b USING (step, idx) WHERE a.s = 'O' AND b.s = 'F') SELECT *, row_number() OVER (ORDER BY step, idx, first, second) - 1 AS place FROM j"""),
    "evaluation_order": (evaluation_order, r"""
WITH f AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS f FROM toy_filter), i AS (SELECT DISTINCT CAST(regexp_extract(f, '^([0-9]+)_', 1) AS BIGINT) AS video_id FROM f WHERE regexp_matches(f, '^[0-9]+_') AND regexp_matches(f, '^[^/]*_[^/]*_ori[^/]*\.mp4$'))
SELECT video_id, row_number() OVER (ORDER BY video_id) - 1 AS place FROM i"""),
    "same_shape_substitute": (same_shape_substitute, f"""
WITH s AS (SELECT sample_id, concat_ws('x', height, width) AS b, num_frame FROM latent_sample),
g AS (SELECT sample_id AS used, b, row_number() OVER (PARTITION BY b ORDER BY md5(sample_id || ':12:0'), sample_id) - 1 AS r, count(*) OVER (PARTITION BY b) AS n FROM s WHERE num_frame IS NOT NULL),
m AS (SELECT b, count(*) AS n FROM g GROUP BY 1)
SELECT sample_id, sample_id AS used FROM s WHERE num_frame IS NOT NULL
UNION ALL SELECT w.sample_id, g.used FROM (SELECT sample_id, s.b, {_H.format('sample_id', 12)} % n AS r FROM s LEFT JOIN m ON m.b = s.b WHERE num_frame IS NULL) w LEFT JOIN g ON g.b = w.b AND g.r = w.r"""),
    "remaining_sample": (remaining_sample, """
WITH l AS (SELECT sample_id, file_path FROM latent_sample WHERE sample_id NOT IN (SELECT prompt_id FROM prompt_table WHERE prompt_id % 2 = 0)),
c AS (SELECT * FROM l ORDER BY md5(sample_id || ':42:0'), sample_id LIMIT 200) SELECT sample_id, row_number() OVER (ORDER BY file_path, sample_id) - 1 AS position FROM c"""),
    "first_rows": (first_rows, "SELECT id, split FROM eval_prompt ORDER BY id LIMIT 100"),
    "first_ids": (first_ids, "SELECT prompt_id, id FROM prompt_table WHERE id IN (SELECT DISTINCT id FROM prompt_table WHERE id IS NOT NULL ORDER BY id LIMIT 50)"),
    "collate_batches": (collate_batches, """
WITH p AS (SELECT *, (row_number() OVER (ORDER BY sample_id) - 1) // 16 AS batch FROM latent_sample)
SELECT batch, string_agg(num_frame, ',' ORDER BY sample_id) AS frames, string_agg(height, ',' ORDER BY sample_id) AS heights, string_agg(width, ',' ORDER BY sample_id) AS widths FROM p WHERE num_frame IS NOT NULL GROUP BY 1"""),
    "stacked_batches": (stacked_batches, f"""
WITH {_E}, n AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 8 AS batch, CASE WHEN label % 2 = 0 THEN v ELSE v[1:vec_id % 3 + 1] END AS v FROM e),
g AS (SELECT label, batch, list(v ORDER BY vec_id) AS a, min(len(v)) AS lo, max(len(v)) AS hi FROM n GROUP BY 1, 2)
SELECT label, batch, CAST(len(a) AS INTEGER) AS items, CAST(CASE WHEN lo = hi THEN lo END AS INTEGER) AS width, CASE WHEN lo = hi THEN {_TXT.format('flatten(a)', 3)} END AS stacked FROM g"""),
    "merged_records": (merged_records, f"WITH {_E} SELECT label, string_agg(vec_id, ',' ORDER BY vec_id) AS ids, {_TXT.format('flatten(list(v[1:3] ORDER BY vec_id))', 4)} AS head, round(arg_min(v[64], vec_id), 6) AS last FROM e GROUP BY 1"),
}
