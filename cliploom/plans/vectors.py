"""Queries on vectors and moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.functions import vectors as v
from cliploom.operators import aggregates
from cliploom.session import table

HEAD = [round(((i * 37) % 64 - 32) / 64, 6) for i in range(64)]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.doubles(F.col("embedding")).alias("v"))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", v.as_text(v.normalized(F.col("v")), 5).alias("unit"))


def cosine_to_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cosine to the first vector of its label."""
    rows = _vectors(spark, sf_dir)
    first = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))
    return rows.join(first, "label").select("vec_id", F.round(v.cosine(F.col("v"), F.col("c")), 6).alias("cosine"))


def l2_nearest_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the five vectors before each one of its label; of equally near ones the earliest."""
    seq = W.partitionBy("label").orderBy("vec_id").rowsBetween(-5, -1)
    rows = _vectors(spark, sf_dir).withColumn("p", F.collect_list(F.struct("vec_id", "v")).over(seq)).filter(F.size("p") > 0)
    best = F.array_min(F.transform("p", lambda o: F.struct(F.round(v.distance(F.col("v"), o["v"]), 9).alias("d"), o["vec_id"].alias("i"))))
    return rows.withColumn("b", best).select("vec_id", F.col("b.i").alias("nearest"), F.round("b.d", 6).alias("distance"))


def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(v.linear_head(F.col("v"), HEAD, 0.25), 6).alias("score"))


def projection_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("p", F.lag("v").over(W.partitionBy("label").orderBy("vec_id"))).filter("p is not null")
    return rows.select("vec_id", F.round(v.projection(F.col("v"), F.col("p")), 6).alias("scale"))


def pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.slice("v", F.lit(1), (F.col("vec_id") % 80).cast("int"))
    rows = _vectors(spark, sf_dir).withColumn("s", short)
    return rows.select("vec_id", v.as_text(v.padded(F.col("s"), 70), 4).alias("padded"), F.array_join(v.mask_of(F.col("s"), 70), "").alias("mask"))


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", *(F.round(v.pooled(F.col("v"), how), 6).alias(how) for how in ("last", "mean", "special")))


def saturate_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = v.saturated(F.col("v"), 1.4), v.noised(F.col("v"), F.reverse("v"), 0.3)
    z = v.standardized(F.col("v"), 0.1, 2.5)
    return _vectors(spark, sf_dir).select("vec_id", v.as_text(x, 5).alias("saturated"), v.as_text(y, 5).alias("noised"), v.as_text(z, 5).alias("standard"))


def pixel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "toy_filter").select("clip_id", "crop").filter("crop is not null")
    values = F.transform("crop", lambda c: (c % 256).cast("double"))
    return rows.select("clip_id", v.as_text(v.pixels(values), 6).alias("pixels"), F.array_join(v.to_bytes(v.pixels(values)), ",").alias("bytes"))


def packed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of each order's lines in the order's packed sequence."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n"))
    total = F.sum("n").over(W.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(W.unboundedPreceding, 0))
    return lines.select("l_orderkey", "l_linenumber", total.alias("cu_seqlen"))


def moments_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _vectors(spark, sf_dir).select("label", F.explode("v").alias("x"))
    return aggregates.moments(flat, "label", "x")


def recommended_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.recommended(moments_by_group(spark, sf_dir))


def amplitude_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("label", "vec_id", F.posexplode("v").alias("pos", "x"))
    return aggregates.amplitude_and_smoothness(rows, "label", ["vec_id", "pos"], "x")


def sample_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", F.explode("v").alias("x"))
    return rows.groupBy("vec_id").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_samp("x"), 6).alias("variance"))


_E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_TXT = "array_to_string(list_transform({}, lambda x: printf('%.{}f', x)), ',')"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"

QUERIES = {
    "l2_normalize": (l2_normalize, _E + f", n AS (SELECT vec_id, v, sqrt({_DOT.format('v', 'v')}) AS n FROM e) SELECT vec_id, {_TXT.format('list_transform(v, lambda x: x / n)', 5)} AS unit FROM n"),
    "cosine_to_centre": (cosine_to_centre, _E + f", c AS (SELECT label, arg_min(v, vec_id) AS c FROM e GROUP BY 1) SELECT vec_id, round({_DOT.format('v', 'c')} / (sqrt({_DOT.format('v', 'v')}) * sqrt({_DOT.format('c', 'c')})), 6) AS cosine FROM e JOIN c USING (label)"),
    "l2_nearest_prior": (l2_nearest_prior, _E + """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM e),
d AS (SELECT a.vec_id, b.vec_id AS o, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d FROM r a JOIN r b ON a.label = b.label AND b.rn BETWEEN a.rn - 5 AND a.rn - 1)
SELECT vec_id, arg_min(o, (d, o)) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY vec_id"""),
    "linear_head": (linear_head, _E + f" SELECT vec_id, round({_DOT.format('v', '[' + ', '.join(f'CAST({x} AS DOUBLE)' for x in HEAD) + ']')} + 0.25, 6) AS score FROM e"),
    "projection_scale": (projection_scale, _E + f", p AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM e) SELECT vec_id, round({_DOT.format('v', 'p')} / ({_DOT.format('p', 'p')} + 1e-8), 6) AS scale FROM p WHERE p IS NOT NULL"),
    "pad_and_mask": (pad_and_mask, _E + f", s AS (SELECT vec_id, v[1:vec_id % 80] AS s FROM e) SELECT vec_id, {_TXT.format('list_transform(range(1, 71), lambda i: coalesce(s[i], 0.0))', 4)} AS padded, array_to_string(list_transform(range(1, 71), lambda i: CASE WHEN i <= len(s) THEN 1 ELSE 0 END), '') AS mask FROM s"),
    "pooled": (pooled, _E + " SELECT vec_id, round(v[64], 6) AS last, round(list_sum(v) / len(v), 6) AS mean, round(v[1], 6) AS special FROM e"),
    "saturate_noise": (saturate_noise, _E + f""", m AS (SELECT *, list_sum(v) / len(v) AS m, list_reverse(v) AS w FROM e)
SELECT vec_id, {_TXT.format('list_transform(v, lambda x: (x - m) * 1.4::DOUBLE + m)', 5)} AS saturated, {_TXT.format('list_transform(list_zip(v, w), lambda z: z[2] * 0.3::DOUBLE + z[1] * 0.7::DOUBLE)', 5)} AS noised, {_TXT.format('list_transform(v, lambda x: (x - 0.1::DOUBLE) * (1.0::DOUBLE / 2.5::DOUBLE))', 5)} AS standard FROM m"""),
    "pixel_round_trip": (pixel_round_trip, f"SELECT clip_id, {_TXT.format('list_transform(crop, lambda c: (c % 256) / 127.5::DOUBLE - 1)', 6)} AS pixels, array_to_string(list_transform(crop, lambda c: c % 256), ',') AS bytes FROM toy_filter WHERE crop IS NOT NULL"),
    "packed_offsets": (packed_offsets, """
WITH l AS (SELECT l_orderkey, l_linenumber, sum(CAST(trunc(l_quantity) AS BIGINT)) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, CAST(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS cu_seqlen FROM l"""),
    "moments_by_group": (moments_by_group, _E + ", x AS (SELECT label, unnest(v) AS x FROM e) SELECT label, count(*) AS n, round(avg(x), 6) AS mean, round(avg(x * x) - avg(x) * avg(x), 6) AS variance, round(sqrt(avg(x * x) - avg(x) * avg(x)), 6) AS std FROM x GROUP BY 1"),
    "recommended_moments": (recommended_moments, _E + ", x AS (SELECT label, unnest(v) AS x FROM e), g AS (SELECT label, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM x GROUP BY 1) SELECT round(avg(mean), 5) AS mean, round(avg(variance), 5) AS variance FROM g"),
    "amplitude_smoothness": (amplitude_smoothness, _E + """, x AS (SELECT label, vec_id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM e), d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY label ORDER BY vec_id, pos)) AS d, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) - 1 AS rn FROM x)
SELECT label, round(abs(avg(x)), 6) AS amplitude, round((255 - avg(CASE WHEN rn % 2 = 1 THEN d END)) / 255, 6) AS smoothness FROM d GROUP BY 1"""),
    "sample_variance": (sample_variance, _E + ", x AS (SELECT vec_id, unnest(v) AS x FROM e) SELECT vec_id, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance FROM x GROUP BY 1"),
}
