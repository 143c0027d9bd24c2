"""Queries on noise schedules, draws and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import schedules as s
from cliploom.functions import vectors as v
from cliploom.operators import sampling
from cliploom.session import table

TARGETS = [742.8216, 547.1926]


def sigma_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.training_sigmas(spark, shift=3.0).select("place", F.round("sigma", 9).alias("sigma"), F.round("timestep", 6).alias("timestep"))


def inference_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of a run in its forms, each named."""
    forms = {"plain": {}, "partial": {"strength": 0.6, "shift": 5.0}, "inverse": {"inverse": True, "extra_step": False}, "reverse": {"reverse": True, "least": 0.003}}
    parts = [s.inference_sigmas(spark, 30, **k).withColumn("form", F.lit(n)) for n, k in forms.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.select("form", "place", F.round("sigma", 9).alias("sigma"), F.round("timestep", 6).alias("timestep"))


def stage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = s.stages(spark, shift=3.0)
    return d.select("stage", "first", "last", F.round("start_sigma", 9).alias("start_sigma"), F.round("end_sigma", 9).alias("end_sigma"), "moved_first")


def sigma_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise of each sample's timestep, which must be one of the schedule's."""
    place = sampling.pick(F.col("sample_id"), "lookup", F.lit(1000))
    wanted = table(spark, sf_dir, "latent_sample").select("sample_id", place.alias("place"))
    schedule = s.training_sigmas(spark, shift=3.0)
    timesteps = wanted.join(schedule.select("place", "timestep"), "place").select("sample_id", "timestep")
    return timesteps.join(schedule.select("timestep", "sigma"), "timestep").select("sample_id", F.round("sigma", 9).alias("sigma"))


def target_timesteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector the entries whose timesteps are nearest to the targets, and the last entry; an entry's timestep is its
    size in thousandths of two."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.doubles(F.col("embedding")).alias("v"))
    places = s.nearest_places(F.transform("v", lambda x: F.abs(x) * 500), TARGETS)
    return rows.withColumn("p", places).select("vec_id", F.array_join("p", ",").alias("places"), v.as_text(s.at_places_and_last(F.col("v"), F.col("p")), 5).alias("picked"))


def uniform_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("sample_id")
    return table(spark, sf_dir, "latent_sample").select("sample_id", s.drawn_sections(i, 2, 9).alias("sections"), s.drawn_timestep(i, shift=5.0).alias("timestep"))


def beta_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("sample_id")
    return table(spark, sf_dir, "latent_sample").select("sample_id", s.drawn_sections(i, 2, 9, "beta", step=300).alias("sections"), s.drawn_timestep(i, "beta", shift=5.0, step=300).alias("timestep"))


def ema_decays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decay at each event, its number being the step."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(s.ema_decay(e, 100), 9).alias("plain"), F.round(s.ema_decay(e, 100, 0.999, 0.1, True, 2.0, 0.75), 9).alias("warm"))


def validation_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight samples for each of five validation steps, another choice at each step, the same in every run."""
    rows = table(spark, sf_dir, "latent_sample").select("sample_id")
    parts = [sampling.first_by_hash(rows, "sample_id", 8, 42 + step).select(F.lit(step).alias("step"), "sample_id") for step in range(0, 500, 100)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SIG = "sig AS (SELECT i AS place, 3.0::DOUBLE * x / (1 + 2.0::DOUBLE * x) AS sigma FROM (SELECT i, (1000 - i) * (1 - 1 / 1000::DOUBLE) / 1000::DOUBLE AS x FROM range(1000) r(i)))"
_PICK = "CAST(('0x' || left(md5({} || ':{}:0'), 8)) AS BIGINT)"
_U = "CAST(('0x' || left(md5(sample_id || ':{}:0'), 8)) AS BIGINT) / 4294967296::DOUBLE"

QUERIES = {
    "sigma_schedule": (sigma_schedule, f"WITH {_SIG} SELECT place, round(sigma, 9) AS sigma, round(sigma * 1000, 6) AS timestep FROM sig"),
    "inference_schedule": (inference_schedule, """
WITH x AS (SELECT 'plain' AS form, i AS place, 1 - i / 30::DOUBLE AS s FROM range(30) r(i)
  UNION ALL SELECT 'partial', i, 5 * (0.6 - i * 0.02::DOUBLE) / (1 + 4 * (0.6 - i * 0.02::DOUBLE)) FROM range(30) r(i)
  UNION ALL SELECT 'inverse', i, 1 - (29 - i) / 29::DOUBLE FROM range(30) r(i)
  UNION ALL SELECT 'reverse', i, 1 - (1 - i * 0.997::DOUBLE / 30) FROM range(30) r(i))
SELECT form, place, round(s, 9) + 0.0 AS sigma, round(s * 1000, 6) + 0.0 AS timestep FROM x"""),
    "stage_ranges": (stage_ranges, f"""
WITH {_SIG}, r(stage, first, last) AS (VALUES (0, 0, 333), (1, 333, 666), (2, 666, 1000)),
e AS (SELECT stage, first, last, a.sigma AS own, coalesce(b.sigma, 0.0) AS end_sigma FROM r JOIN sig a ON a.place = first LEFT JOIN sig b ON b.place = last),
m AS (SELECT *, CASE WHEN stage = 0 THEN own ELSE 1 - (1 - own) / (2.0::DOUBLE * own + (1 - own)) END AS start_sigma FROM e)
SELECT stage, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, round(start_sigma, 9) AS start_sigma, round(end_sigma, 9) AS end_sigma, (SELECT count(*) FROM sig WHERE sigma > start_sigma) AS moved_first FROM m"""),
    "sigma_lookup": (sigma_lookup, f"WITH {_SIG} SELECT sample_id, round(sigma, 9) AS sigma FROM latent_sample JOIN sig ON place = {_PICK.format('sample_id', 'lookup')} % 1000"),
    "target_timesteps": (target_timesteps, """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT vec_id, v, list_transform(v, lambda x: abs(abs(x) * 500 - 742.8216::DOUBLE)) AS a, list_transform(v, lambda x: abs(abs(x) * 500 - 547.1926::DOUBLE)) AS b FROM e),
p AS (SELECT vec_id, v, list_position(a, list_min(a)) AS pa, list_position(b, list_min(b)) AS pb FROM g)
SELECT vec_id, (pa - 1) || ',' || (pb - 1) AS places, array_to_string(list_transform([v[pa], v[pb], v[64]], lambda x: printf('%.5f', x)), ',') AS picked FROM p"""),
    "uniform_draws": (uniform_draws, f"""
WITH u AS (SELECT sample_id, 2 + {_U.format('sections')} * 7 AS n, ({_U.format('timestep')} * (1.0::DOUBLE - 0.001::DOUBLE) + 0.001::DOUBLE) AS t FROM latent_sample)
SELECT sample_id, CAST(least(greatest(round_even(n, 0), 2), 9) AS INTEGER) AS sections, CAST(round_even(least(greatest(5 * t / (1 + 4 * t) * 1000, 20), 980), 0) AS BIGINT) AS timestep FROM u"""),
    "beta_draws": (beta_draws, None),
    "ema_decays": (ema_decays, """
WITH n AS (SELECT event_id, CAST(greatest(0, event_id - 101) AS DOUBLE) AS n FROM events)
SELECT event_id, round(CASE WHEN n <= 0 THEN 0 ELSE least((1 + n) / (10 + n), 0.9999::DOUBLE) END, 9) AS plain,
  round(CASE WHEN n <= 0 THEN 0 ELSE greatest(least(1 - pow(1 + n / 2, -0.75::DOUBLE), 0.999::DOUBLE), 0.1::DOUBLE) END, 9) AS warm FROM n"""),
    "validation_pick": (validation_pick, """
WITH s AS (SELECT step, sample_id, row_number() OVER (PARTITION BY step ORDER BY md5(sample_id || ':' || (42 + step) || ':0'), sample_id) AS r FROM latent_sample, range(0, 500, 100) t(step))
SELECT CAST(step AS INTEGER) AS step, sample_id FROM s WHERE r <= 8"""),
}
