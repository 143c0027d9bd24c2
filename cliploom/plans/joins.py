"""Queries on joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import dims, shapes
from cliploom.operators import joins, ordering
from cliploom.session import table

GRID = [0.0, 250.0, 500.0, 750.0, 900.0, 1000.0, 1250.0, 1500.0, 2000.0]


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "toy_filter").select("clip_id", "cut", "num_frames", shapes.stem(F.col("path")).alias("video"))


def semi_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.existing(_stems(spark, sf_dir).select("clip_id", "video"), table(spark, sf_dir, "action_segments").select("video").distinct(), "video")


def anti_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _stems(spark, sf_dir).withColumn("uttid", F.format_string("%s_%07d_%07d", "video", F.get("cut", F.lit(0)), F.get("cut", F.lit(1)))).filter("uttid is not null")
    return joins.remaining(work.select("clip_id", "uttid"), table(spark, sf_dir, "latent_sample").select("uttid").distinct(), "uttid")


def interval_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = _stems(spark, sf_dir).groupBy("video").agg(F.floor(F.max("num_frames") / 33).cast("bigint").alias("chunks"))
    return joins.chunk_labels(videos, table(spark, sf_dir, "action_segments"))


def tiered_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _stems(spark, sf_dir).select(F.substring_index("video", "_", 2).alias("name")).unionByName(table(spark, sf_dir, "action_segments").select(F.col("video").alias("name")))
    return joins.tiered_names(table(spark, sf_dir, "prompt_table").select("prompt_id", "id"), names, "id").select("prompt_id", "resolved", "tier")


def precedence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caption per video: refined captions before plain ones, then a default for labelled videos without one."""
    p = table(spark, sf_dir, "prompt_table").filter("id is not null")
    sources = [p.filter(F.trim(c) != "").select("id", "prompt_id", F.col(c).alias("caption")) for c in ("refined_prompt", "prompt")]
    captions = joins.by_precedence(sources, "id", "prompt_id")
    videos = table(spark, sf_dir, "action_segments").select(F.col("video").alias("id")).distinct()
    out = videos.join(captions, "id", "left")
    return out.select("id", F.coalesce("caption", F.lit("A first-person view of a scene.")).alias("caption"), F.substring_index("id", "_", 1).alias("action_class"))


def manifest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clip the newest action text of its video, "" where there is none."""
    p = table(spark, sf_dir, "prompt_table").filter("id is not null and chunk_actions_json is not null")
    newest = p.groupBy(F.col("id").alias("video")).agg(F.max_by("chunk_actions_json", "prompt_id").alias("actions"))
    return _stems(spark, sf_dir).select("clip_id", "video").join(newest, "video", "left").select("clip_id", F.coalesce("actions", F.lit("")).alias("actions"))


def unique_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = joins.unique_or_fail(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "customer keys repeat")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(customers, "c_custkey").select("o_orderkey", "c_name")


def cached_union_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _stems(spark, sf_dir).filter("video is not null").select("video")
    return joins.with_cached(wanted, table(spark, sf_dir, "prompt_table").select(F.col("id").alias("video")), "video")


def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_action_ids(table(spark, sf_dir, "action_segments")).select("seg_id", "action_id")


def nearest_point_first_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = joins.nearest(F.col("p_retailprice"), GRID)
    return table(spark, sf_dir, "part").select("p_partkey", n["place"].alias("place"), n["point"].alias("point"))


def vocab_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each action of the vocabulary, those that never occur included."""
    used = table(spark, sf_dir, "action_segments").groupBy(F.col("action_keys").alias("keys"), F.col("action_mouse").alias("mouse")).agg(F.count(F.lit(1)).alias("segments"))
    return dims.vocabulary(spark).join(used, ["keys", "mouse"], "left").select("action_id", "keys", "mouse", F.coalesce("segments", F.lit(0)).alias("segments"))


def sibling_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-size sample of each half- and quarter-size one. Smaller versions of all samples are listed beside them, as
    the tools that make them would name them, and found by nothing but their paths and sizes."""
    s = table(spark, sf_dir, "latent_sample").filter("height is not null and width is not null")
    stem_of = F.regexp_extract("file_path", r"^(.*)_\d+_\d+\.pt$", 1)
    small = []
    for part, folder in ((2, "mid"), (4, "low")):
        h, w = F.floor(F.col("height") / part).cast("int"), F.floor(F.col("width") / part).cast("int")
        name = F.regexp_replace(stem_of, r"/([^/]*)$", F.concat(F.lit(f"/{folder}/"), F.lit("$1")))
        small.append(s.filter(stem_of != "").select("sample_id", F.lit(part).alias("part"), F.format_string("%s_%d_%d.pt", name, h, w).alias("path"), "height", "width"))
    listed = small[0].unionByName(small[1]).withColumn("full_path", joins.full_resolution_path(F.col("path"), F.col("height"), F.col("width")))
    full = s.groupBy(F.col("file_path").alias("full_path")).agg(F.min("sample_id").alias("full_id"))
    return listed.join(full, "full_path").select("sample_id", "part", "full_id")


def positional_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation prompts beside samples and configurations by place, shorter sources repeated from their start."""
    p = ordering.positions(table(spark, sf_dir, "eval_prompt").select("id"), [F.col("id")])
    s = ordering.positions(table(spark, sf_dir, "lang_sample").select("sample_id"), [F.col("sample_id")])
    c = ordering.positions(table(spark, sf_dir, "data_config").select("config_id"), [F.col("config_id")])
    for d, n in ((s, "ns"), (c, "nc")):
        p = ordering.with_totals(p, d.agg(F.count(F.lit(1)).alias(n)))
    keyed = p.select("id", "position", (F.col("position") % F.col("ns")).alias("sp"), (F.col("position") % F.col("nc")).alias("cp"))
    out = keyed.join(s.withColumnRenamed("position", "sp"), "sp").join(c.withColumnRenamed("position", "cp"), "cp")
    return out.select("position", "id", "sample_id", "config_id")


def caption_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption of each prompt row and the tier it comes from."""
    tiers = [F.when(F.trim(c) != "", F.col(c)) for c in ("refined_prompt", "prompt_original", "prompt")]
    source = F.coalesce(*(F.when(t.isNotNull(), F.lit(n)) for t, n in zip(tiers, ("refined", "original", "plain"))))
    return table(spark, sf_dir, "prompt_table").select("prompt_id", F.coalesce(*tiers).alias("caption"), source.alias("tier"))


def dup_name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "data_config").select("config_id", F.explode("instance_data_root").alias("root"))
    names = roots.unionByName(table(spark, sf_dir, "latent_sample").select(F.lit(0).cast("bigint").alias("config_id"), F.col("dataset_name").alias("root")))
    return joins.repeated_names(names.filter("root is not null"), "config_id", F.regexp_replace("root", "/+$", ""))


_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]+$', '')"
_CLIPS = f"WITH clips AS (SELECT *, {_STEM} AS video FROM toy_filter)"
_VOC = "voc AS (SELECT k.i * 9 + m.i AS action_id, k.v AS keys, m.v AS mouse FROM (" + dims.sql_values(list(enumerate(dims.KEYS))) + ") k(i, v), (" + dims.sql_values(list(enumerate(dims.MOUSE))) + ") m(i, v))"

QUERIES = {
    "semi_existing": (semi_existing, _CLIPS + " SELECT clip_id, video FROM clips WHERE video IN (SELECT video FROM action_segments)"),
    "anti_done": (anti_done, _CLIPS + ", w AS (SELECT clip_id, printf('%s_%07d_%07d', video, cut[1], cut[2]) AS uttid FROM clips) SELECT * FROM w WHERE uttid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM latent_sample l WHERE l.uttid = w.uttid)"),
    "interval_first_match": (interval_first_match, _CLIPS + """, v AS (SELECT video, CAST(floor(max(num_frames) / 33) AS BIGINT) AS chunks FROM clips WHERE video IS NOT NULL GROUP BY 1),
p AS (SELECT video, unnest(range(0, chunks)) AS chunk FROM v),
j AS (SELECT p.video, p.chunk, s.action_keys, s.action_mouse, s.seg_id, row_number() OVER (PARTITION BY p.video, p.chunk ORDER BY s.start_frame, s.seg_id) AS rn
  FROM p LEFT JOIN action_segments s ON s.video = p.video AND s.start_frame <= p.chunk * 33 + 16 AND s.end_frame >= p.chunk * 33 + 16)
SELECT video, chunk, coalesce(action_keys, 'None') AS keys, coalesce(action_mouse, '·') AS mouse FROM j WHERE rn = 1"""),
    "tiered_name_join": (tiered_name_join, _CLIPS + """, names AS (SELECT array_to_string(string_split(video, '_')[1:2], '_') AS n FROM clips UNION SELECT video FROM action_segments),
q AS (SELECT prompt_id, id, array_to_string(string_split(id, '_')[1:2], '_') AS short FROM prompt_table)
SELECT prompt_id, CASE WHEN id IN (SELECT n FROM names WHERE n IS NOT NULL) THEN id WHEN short IN (SELECT n FROM names WHERE n IS NOT NULL) THEN short ELSE id END AS resolved,
  CASE WHEN id IN (SELECT n FROM names WHERE n IS NOT NULL) THEN 'exact' WHEN short IN (SELECT n FROM names WHERE n IS NOT NULL) THEN 'short' ELSE 'none' END AS tier FROM q"""),
    "precedence_union": (precedence_union, """
WITH s AS (SELECT id, prompt_id, refined_prompt AS caption, 0 AS r FROM prompt_table WHERE trim(refined_prompt) <> '' UNION ALL SELECT id, prompt_id, prompt, 1 FROM prompt_table WHERE trim(prompt) <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, prompt_id DESC) AS rn FROM s WHERE id IS NOT NULL)
SELECT v.video AS id, coalesce(b.caption, 'A first-person view of a scene.') AS caption, string_split(v.video, '_')[1] AS action_class FROM (SELECT DISTINCT video FROM action_segments) v LEFT JOIN b ON b.id = v.video AND b.rn = 1"""),
    "manifest_actions": (manifest_actions, _CLIPS + """, n AS (SELECT id, arg_max(chunk_actions_json, prompt_id) AS actions FROM prompt_table WHERE id IS NOT NULL AND chunk_actions_json IS NOT NULL GROUP BY 1)
SELECT clip_id, coalesce(actions, '') AS actions FROM clips LEFT JOIN n ON n.id = clips.video"""),
    "unique_key_join": (unique_key_join, "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "cached_union_new": (cached_union_new, _CLIPS + " SELECT DISTINCT video, video IN (SELECT id FROM prompt_table WHERE id IS NOT NULL) AS reuse FROM clips WHERE video IS NOT NULL"),
    "lookup_default": (lookup_default, f"WITH {_VOC} SELECT seg_id, coalesce(action_id, 80) AS action_id FROM action_segments LEFT JOIN voc ON action_keys = keys AND action_mouse = mouse"),
    "nearest_point_first_tie": (nearest_point_first_tie, f"""WITH g(place, point) AS ({dims.sql_values(list(enumerate(GRID)))}),
r AS (SELECT p_partkey, place, point, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_retailprice - point), place) AS rn FROM part, g) SELECT p_partkey, place, point FROM r WHERE rn = 1"""),
    "vocab_cross": (vocab_cross, f"WITH {_VOC} SELECT action_id, keys, mouse, count(seg_id) AS segments FROM voc LEFT JOIN action_segments ON action_keys = keys AND action_mouse = mouse GROUP BY ALL"),
    "sibling_resolution": (sibling_resolution, r"""
WITH f AS (SELECT sample_id, file_path, min(sample_id) OVER (PARTITION BY file_path) AS full_id FROM latent_sample WHERE height IS NOT NULL AND width IS NOT NULL)
SELECT sample_id, part, full_id FROM f, (VALUES (2), (4)) p(part) WHERE regexp_matches(file_path, '_[0-9]+_[0-9]+\.pt$')"""),
    "positional_alignment": (positional_alignment, """
WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM eval_prompt), s AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS sp, count(*) OVER () AS n FROM lang_sample),
c AS (SELECT config_id, row_number() OVER (ORDER BY config_id) - 1 AS cp, count(*) OVER () AS n FROM data_config)
SELECT position, id, sample_id, config_id FROM p JOIN s ON sp = position % s.n JOIN c ON cp = position % c.n"""),
    "caption_tiers": (caption_tiers, """
SELECT prompt_id, CASE WHEN trim(refined_prompt) <> '' THEN refined_prompt WHEN trim(prompt_original) <> '' THEN prompt_original WHEN trim(prompt) <> '' THEN prompt END AS caption,
  CASE WHEN trim(refined_prompt) <> '' THEN 'refined' WHEN trim(prompt_original) <> '' THEN 'original' WHEN trim(prompt) <> '' THEN 'plain' END AS tier FROM prompt_table"""),
    "dup_name_check": (dup_name_check, """
WITH r AS (SELECT config_id, unnest(instance_data_root) AS root FROM data_config UNION ALL SELECT 0, dataset_name FROM latent_sample)
SELECT config_id, regexp_replace(root, '/+$', '') AS name, count(*) AS times FROM r WHERE root IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""),
}
