"""Queries on clip manifests: derived columns, buckets and frame numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import dims, shapes
from cliploom.session import table
from cliploom.sources import manifests

_L = lambda xs: "[" + ", ".join(map(str, xs)) + "]"


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "toy_filter")


def derive_cut_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.derived(_clips(spark, sf_dir)).select("clip_id", "uttid", "num_frame", "height", "width", "prompt", "video_path")


def min_len_allowed_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.derived(_clips(spark, sf_dir))
    return manifests.long_enough(manifests.allowed_shape(rows, [(480, 832), (384, 640), (192, 320)]), 66).select("clip_id", "num_frame", "height", "width")


def fps_stride_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.derived(_clips(spark, sf_dir)).withColumn("stride", shapes.fps_stride(F.col("fps"), 16.0))
    rows = rows.withColumn("bucket", shapes.nearest_length(F.col("num_frame"), dims.LENGTHS_2))
    return rows.filter(F.col("bucket") * F.col("stride") < F.col("num_frame")).select("clip_id", "stride", "bucket", shapes.ceil_div(F.col("num_frame"), F.col("stride")).alias("effective"))


def nearest_resolution_last_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.derived(_clips(spark, sf_dir)).filter("height is not null and width is not null")
    b = shapes.nearest_resolution(F.col("height"), F.col("width"))
    return rows.groupBy("height", "width").agg(F.count(F.lit(1)).alias("clips")).select("height", "width", b["height"].alias("bucket_height"), b["width"].alias("bucket_width"), "clips")


def nearest_length_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.derived(_clips(spark, sf_dir)).filter("num_frame is not null")
    return rows.groupBy("num_frame").agg(F.count(F.lit(1)).alias("clips")).select("num_frame", "clips", shapes.nearest_length(F.col("num_frame"), dims.LENGTHS_1).alias("by_1"), shapes.nearest_length(F.col("num_frame"), dims.LENGTHS_2).alias("by_2"))


def bucket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips and smallest clip of each (frames, height, width) bucket."""
    rows = manifests.bucketed(manifests.derived(_clips(spark, sf_dir)), 1)
    return rows.groupBy("bucket_frames", "bucket_height", "bucket_width").agg(F.count(F.lit(1)).alias("clips"), F.min("clip_id").alias("first_clip"))


def manifest_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.skip_reasons(_clips(spark, sf_dir), 81, 16.0).groupBy("reason").agg(F.count(F.lit(1)).alias("clips"))


def metadata_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.latent_names(table(spark, sf_dir, "latent_sample"), "file_path").select("sample_id", "uttid", "num_frames", "file_height", "file_width", "root")


def frame_index_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).filter("num_frames > 0").select("num_frames").distinct()
    return rows.select("num_frames", F.array_join(shapes.middle_frames(48, F.col("num_frames")), ",").alias("frames"))


def frame_index_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).filter("num_frames > 0 and fps > 0").select("num_frames", "fps").distinct()
    return rows.select("num_frames", "fps", F.array_join(shapes.fps_frames(2.0, F.col("num_frames"), F.col("fps")), ",").alias("frames"))


def portion_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).filter("num_frames > 0").select("num_frames").distinct()
    head, tail = shapes.portion(F.col("num_frames"), 0.0, 0.15, 8), shapes.portion(F.col("num_frames"), 0.85, 1.0, 8)
    return rows.select("num_frames", head["start"].alias("head_start"), head["end"].alias("head_end"), tail["start"].alias("tail_start"), tail["end"].alias("tail_end"))


def align_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", shapes.aligned(F.col("p_size"), 4).alias("by_4"), shapes.aligned(F.col("p_retailprice"), 2).alias("by_2"))


def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.derived(_clips(spark, sf_dir)).filter("height > 0 and width > 0").groupBy("height", "width").agg(F.count(F.lit(1)).alias("clips"))
    r = shapes.resized(F.col("height"), F.col("width"), 28, 3136, 200704)
    return rows.select("height", "width", "clips", r["height"].alias("to_height"), r["width"].alias("to_width"))


def sampled_frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).filter("num_frames > 0 and fps > 0").groupBy("num_frames", "fps").agg(F.count(F.lit(1)).alias("clips"))
    return rows.select("num_frames", "fps", "clips", shapes.sampled_frames(F.col("num_frames"), F.col("fps")).alias("n"), shapes.clip_fps(F.col("num_frames"), F.col("fps")).alias("fps_set"), shapes.clip_fps(F.col("num_frames"), F.col("fps"), True).alias("fps_compat"))


def uniform_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).filter("num_frames > 0").select("num_frames").distinct()
    return rows.select("num_frames", F.array_join(shapes.uniform_frames(F.col("num_frames"), 12), ",").alias("frames"))


def centre_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.derived(_clips(spark, sf_dir)).filter("height > 0 and width > 0").select("height", "width").distinct()
    c = shapes.centre_crop(F.col("height"), F.col("width"), F.lit(384), F.lit(640))
    return rows.select("height", "width", c["top"].alias("top"), c["left"].alias("left_"), c["height"].alias("crop_height"), c["width"].alias("crop_width"))


def shift_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir).filter("num_frames > 0").select("num_frames").distinct()
    mu = F.exp(shapes.shift_of(F.col("num_frames") * 10))
    return rows.select("num_frames", F.round(mu, 8).alias("mu"), *(F.round(shapes.shifted(F.lit(s), mu), 8).alias(f"sigma_{int(s * 100)}") for s in (0.25, 0.5, 0.75)))


_D = """
WITH d AS (SELECT *, cut[2] - cut[1] AS num_frame, crop[2] - crop[1] AS width, crop[4] - crop[3] AS height, cap[1] AS prompt FROM toy_filter)
"""
_NEAR = "(SELECT arg_min(b, (abs(height * b.w - width * b.h), -b.i)) FROM (SELECT unnest([" + ", ".join(f"{{'h': {h}, 'w': {w}, 'i': {i}}}" for i, (h, w) in enumerate(dims.RESOLUTIONS)) + "]) AS b))"
_LEN1 = f"coalesce(list_max(list_filter({_L(dims.LENGTHS_1)}, lambda b: b <= num_frame)), num_frame)"
_LEN2 = f"coalesce(list_max(list_filter({_L(dims.LENGTHS_2)}, lambda b: b <= num_frame)), num_frame)"
_JOINED = "array_to_string({}, ',')"

QUERIES = {
    "derive_cut_crop": (derive_cut_crop, _D + r"""
SELECT clip_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]+$', '') || coalesce('_' || nullif(concat_ws('-', cut[1], cut[2]), ''), '_') AS uttid, num_frame, height, width, prompt,
  replace(replace(replace(path, 'videos_clip_v1/', ''), './', ''), 'videos/', '') AS video_path FROM d"""),
    "min_len_allowed_shape": (min_len_allowed_shape, _D + "SELECT clip_id, num_frame, height, width FROM d WHERE num_frame >= 66 AND (height, width) IN ((480, 832), (384, 640), (192, 320))"),
    "fps_stride_filter": (fps_stride_filter, _D + f""", s AS (SELECT *, CAST(greatest(floor(fps / 16.0::DOUBLE), 1) AS INTEGER) AS stride, {_LEN2} AS bucket FROM d WHERE fps IS NOT NULL)
SELECT clip_id, stride, bucket, CAST(floor((num_frame + stride - 1) / stride) AS BIGINT) AS effective FROM s WHERE bucket * stride < num_frame"""),
    "nearest_resolution_last_tie": (nearest_resolution_last_tie, _D + f""", g AS (SELECT height, width, count(*) AS clips FROM d WHERE height IS NOT NULL AND width IS NOT NULL GROUP BY 1, 2),
o(h, w, i) AS ({dims.sql_values([(h, w, i) for i, (h, w) in enumerate(dims.RESOLUTIONS)])}),
r AS (SELECT *, row_number() OVER (PARTITION BY height, width ORDER BY abs(height * w - width * h), i DESC) AS rn FROM g CROSS JOIN o)
SELECT height, width, h AS bucket_height, w AS bucket_width, clips FROM r WHERE rn = 1"""),
    "nearest_length_floor": (nearest_length_floor, _D + f"SELECT num_frame, count(*) AS clips, {_LEN1} AS by_1, {_LEN2} AS by_2 FROM d WHERE num_frame IS NOT NULL GROUP BY num_frame"),
    "bucket_index": (bucket_index, _D + f""", o(h, w, i) AS ({dims.sql_values([(h, w, i) for i, (h, w) in enumerate(dims.RESOLUTIONS)])}),
g AS (SELECT DISTINCT height, width FROM d WHERE height IS NOT NULL AND width IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY height, width ORDER BY abs(height * w - width * h), i DESC) AS rn FROM g CROSS JOIN o)
SELECT {_LEN1} AS bucket_frames, h AS bucket_height, w AS bucket_width, count(*) AS clips, min(clip_id) AS first_clip FROM d JOIN r USING (height, width) WHERE rn = 1 AND num_frame IS NOT NULL GROUP BY 1, 2, 3"""),
    "manifest_skip_reasons": (manifest_skip_reasons, _D + f""", s AS (SELECT *, {_LEN1} AS bucket, CAST(greatest(floor(fps / 16.0::DOUBLE), 1) AS INTEGER) AS stride FROM d)
SELECT CASE WHEN path IS NULL OR num_frame IS NULL OR height IS NULL OR width IS NULL THEN 'incomplete' WHEN num_frame < 81 THEN 'too short' WHEN coalesce(trim(prompt), '') = '' THEN 'no caption'
  WHEN fps IS NULL THEN 'no frame rate' WHEN bucket * stride >= num_frame THEN 'too few frames at this rate' ELSE 'kept' END AS reason, count(*) AS clips FROM s GROUP BY 1"""),
    "metadata_from_name": (metadata_from_name, r"""
SELECT sample_id, regexp_extract(f, '^(.*)_([0-9]+)_([0-9]+)_([0-9]+)\.pt$', 1) AS uttid, CAST(regexp_extract(f, '^(.*)_([0-9]+)_([0-9]+)_([0-9]+)\.pt$', 2) AS INTEGER) AS num_frames,
  CAST(regexp_extract(f, '^(.*)_([0-9]+)_([0-9]+)_([0-9]+)\.pt$', 3) AS INTEGER) AS file_height, CAST(regexp_extract(f, '^(.*)_([0-9]+)_([0-9]+)_([0-9]+)\.pt$', 4) AS INTEGER) AS file_width,
  regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS root FROM (SELECT *, regexp_extract(file_path, '([^/]*)$', 1) AS f FROM latent_sample) WHERE regexp_matches(f, '^(.*)_([0-9]+)_([0-9]+)_([0-9]+)\.pt$')"""),
    "frame_index_middle": (frame_index_middle, """
WITH v AS (SELECT DISTINCT num_frames AS n, least(48, num_frames) AS k FROM toy_filter WHERE num_frames > 0),
e AS (SELECT n, k, list_transform(range(0, k + 1), lambda i: CASE WHEN i = k THEN n ELSE CAST(floor(CAST(i AS DOUBLE) * (CAST(n AS DOUBLE) / k)) AS BIGINT) END) AS e FROM v),
m AS (SELECT n, k, list_transform(range(1, k + 1), lambda i: CAST(floor((e[i] + e[i + 1] - 1) / 2) AS BIGINT)) AS m FROM e)
SELECT n AS num_frames, array_to_string(list_transform(range(1, 49), lambda i: m[least(i, k)]), ',') AS frames FROM m"""),
    "frame_index_fps": (frame_index_fps, """
WITH v AS (SELECT DISTINCT num_frames AS n, fps FROM toy_filter WHERE num_frames > 0 AND fps > 0)
SELECT n AS num_frames, fps, array_to_string(list_filter(list_transform(range(0, greatest(CAST(ceil(CAST(n AS DOUBLE) / fps / 0.5::DOUBLE) AS BIGINT), 1)), lambda i: CAST(round_even((0.25::DOUBLE + i * 0.5::DOUBLE) * fps, 0) AS BIGINT)), lambda f: f < n), ',') AS frames FROM v"""),
    "portion_frames": (portion_frames, """
WITH v AS (SELECT DISTINCT num_frames AS n FROM toy_filter WHERE num_frames > 0), p AS (SELECT n, 0 AS a, CAST(floor(n * 0.15::DOUBLE) AS INTEGER) AS b, CAST(floor(n * 0.85::DOUBLE) AS INTEGER) AS c, n AS d FROM v),
q AS (SELECT *, greatest(0, a - CAST(ceil((8 - (b - a)) / 2.0) AS INTEGER)) AS wa, least(n, b + CAST(floor((8 - (b - a)) / 2.0) AS INTEGER)) AS wb,
  greatest(0, c - CAST(ceil((8 - (d - c)) / 2.0) AS INTEGER)) AS wc, least(n, d + CAST(floor((8 - (d - c)) / 2.0) AS INTEGER)) AS wd FROM p)
SELECT n AS num_frames, CASE WHEN b - a >= 8 THEN a WHEN wb - wa < 8 AND wa <> 0 AND wb = n THEN greatest(0, wb - 8) ELSE wa END AS head_start, CASE WHEN b - a >= 8 THEN b WHEN wb - wa < 8 AND wa = 0 THEN least(n, wa + 8) ELSE wb END AS head_end,
  CASE WHEN d - c >= 8 THEN c WHEN wd - wc < 8 AND wc <> 0 AND wd = n THEN greatest(0, wd - 8) ELSE wc END AS tail_start, CASE WHEN d - c >= 8 THEN d WHEN wd - wc < 8 AND wc = 0 THEN least(n, wc + 8) ELSE wd END AS tail_end FROM q"""),
    "align_even": (align_even, "SELECT p_partkey, CAST(round_even(p_size / 4, 0) * 4 AS INTEGER) AS by_4, CAST(round_even(p_retailprice / 2, 0) * 2 AS INTEGER) AS by_2 FROM part"),
    "smart_resize": (smart_resize, _D + """, g AS (SELECT height, width, count(*) AS clips, greatest(28, CAST(round_even(height / 28, 0) * 28 AS INTEGER)) AS h, greatest(28, CAST(round_even(width / 28, 0) * 28 AS INTEGER)) AS w,
  sqrt(CAST(height AS DOUBLE) * width / 200704) AS dn, sqrt(3136.0::DOUBLE / (CAST(height AS DOUBLE) * width)) AS up FROM d WHERE height > 0 AND width > 0 GROUP BY height, width)
SELECT height, width, clips, CASE WHEN greatest(height, width) / least(height, width) <= 200 THEN CAST(CASE WHEN h * w > 200704 THEN floor(height / dn / 28) * 28 WHEN h * w < 3136 THEN ceil(height * up / 28) * 28 ELSE h END AS INTEGER) END AS to_height,
  CASE WHEN greatest(height, width) / least(height, width) <= 200 THEN CAST(CASE WHEN h * w > 200704 THEN floor(width / dn / 28) * 28 WHEN h * w < 3136 THEN ceil(width * up / 28) * 28 ELSE w END AS INTEGER) END AS to_width FROM g"""),
    "sampled_frame_count": (sampled_frame_count, """
WITH g AS (SELECT num_frames, fps, count(*) AS clips, least(greatest(CAST(num_frames AS DOUBLE) / fps * 2.0, 4.0), floor(least(768, num_frames) / 2) * 2) AS r FROM toy_filter WHERE num_frames > 0 AND fps > 0 GROUP BY 1, 2),
n AS (SELECT *, CAST(least(round_even(r / 2, 0) * 2, num_frames) AS INTEGER) AS k FROM g)
SELECT num_frames, fps, clips, CASE WHEN k >= 2 AND k <= num_frames THEN k END AS n, CASE WHEN num_frames <= 49 THEN 8.0 WHEN num_frames <= 93 THEN 16.0 ELSE fps END AS fps_set, CASE WHEN num_frames <= 93 THEN 16.0 ELSE fps END AS fps_compat FROM n"""),
    "uniform_index": (uniform_index, """
SELECT num_frames, array_to_string(list_transform(range(0, 12), lambda i: CAST(round_even(i * (CAST(num_frames - 1 AS DOUBLE) / 11), 0) AS BIGINT)), ',') AS frames FROM (SELECT DISTINCT num_frames FROM toy_filter WHERE num_frames > 0)"""),
    "centre_crop": (centre_crop, _D + """, g AS (SELECT DISTINCT height, width FROM d WHERE height > 0 AND width > 0),
c AS (SELECT *, CAST(CASE WHEN width * 384 > height * 640 THEN height ELSE floor(width * 384 / 640) END AS INTEGER) AS ch, CAST(CASE WHEN width * 384 > height * 640 THEN floor(height * 640 / 384) ELSE width END AS INTEGER) AS cw FROM g)
SELECT height, width, CAST(floor((height - ch) / 2) AS INTEGER) AS top, CAST(floor((width - cw) / 2) AS INTEGER) AS left_, ch AS crop_height, cw AS crop_width FROM c"""),
    "shift_schedule": (shift_schedule, """
WITH m AS (SELECT DISTINCT num_frames, exp(num_frames * 10 * (0.65::DOUBLE / 3840) + (0.5::DOUBLE - 0.65::DOUBLE / 3840 * 256)) AS mu FROM toy_filter WHERE num_frames > 0)
SELECT num_frames, round(mu, 8) AS mu, round(0.25::DOUBLE * mu / (1 + (mu - 1) * 0.25::DOUBLE), 8) AS sigma_25, round(0.5::DOUBLE * mu / (1 + (mu - 1) * 0.5::DOUBLE), 8) AS sigma_50, round(0.75::DOUBLE * mu / (1 + (mu - 1) * 0.75::DOUBLE), 8) AS sigma_75 FROM m"""),
}
