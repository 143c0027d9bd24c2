"""Noise schedules and the timesteps picked from them. A schedule is a fixed short list, so it is a small table or a column
of a few entries; whatever is looked up in it stays distributed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.operators.sampling import chance

#: Training steps, shift, stage borders and gamma.
STEPS, SHIFT, STAGES, GAMMA = 1000, 1.0, (0.0, 1 / 3, 2 / 3, 1.0), 1 / 3


def shifted_sigma(sigma: Column, shift: float) -> Column:
    return F.lit(shift) * sigma / (1 + F.lit(shift - 1) * sigma)


def training_sigmas(spark: SparkSession, steps: int = STEPS, shift: float = SHIFT) -> DataFrame:
    """(place, sigma, timestep) from the noisiest step on."""
    left = F.lit(steps) - F.col("id")
    sigma = shifted_sigma(left * F.lit(1 - 1 / steps) / F.lit(float(steps)), shift)
    return spark.range(steps).select(F.col("id").alias("place"), sigma.alias("sigma")).withColumn("timestep", F.col("sigma") * steps)


def inference_sigmas(spark: SparkSession, steps: int = 50, strength: float = 1.0, shift: float = 1.0, most: float = 1.0, least: float = 0.0, training: int = STEPS, inverse: bool = False, extra_step: bool = True, reverse: bool = False) -> DataFrame:
    """(place, sigma, timestep) of a run of ``steps`` steps: evenly spaced from the start that ``strength`` sets, with one more
    step at the end that is left out, in turned order, or turned from 1, as asked."""
    start = least + (most - least) * strength
    gaps = steps if extra_step else max(1, steps - 1)
    at = F.lit(steps - 1) - F.col("id") if inverse else F.col("id")
    sigma = shifted_sigma(F.lit(start) + at * F.lit((least - start) / gaps), shift)
    sigma = 1 - sigma if reverse else sigma
    return spark.range(steps).select(F.col("id").alias("place"), sigma.alias("sigma")).withColumn("timestep", F.col("sigma") * training)


def stages(spark: SparkSession, steps: int = STEPS, shift: float = SHIFT, borders: tuple[float, ...] = STAGES, gamma: float = GAMMA) -> DataFrame:
    """(stage, first, last, start_sigma, end_sigma, moved_first): the places [first, last) of each stage, the noise it starts
    and ends with, the start of later stages being lowered to what the blend of the stage before leaves, and the first place
    whose noise is not above that."""
    rows = [(i, max(int(a * steps), 0), min(int(b * steps), steps)) for i, (a, b) in enumerate(zip(borders, borders[1:]))]
    sigmas = training_sigmas(spark, steps, shift)
    named = lambda place, sigma: sigmas.select(F.col("place").alias(place), F.col("sigma").alias(sigma))
    out = spark.createDataFrame(rows, "stage int, first bigint, last bigint").join(named("first", "_own"), "first").join(named("last", "end_sigma"), "last", "left")
    clean = 1 - F.col("_own")
    lowered = 1 - clean / (F.lit(math.sqrt(1 + 1 / gamma)) * (1 - clean) + clean)
    out = out.withColumn("start_sigma", F.when(F.col("stage") == 0, F.col("_own")).otherwise(lowered)).withColumn("end_sigma", F.coalesce("end_sigma", F.lit(0.0)))
    above = out.select("stage", "start_sigma").join(sigmas.select("sigma"), F.col("sigma") > F.col("start_sigma"), "left").groupBy("stage").agg(F.count("sigma").alias("moved_first"))
    return out.join(above, "stage").select("stage", "first", "last", "start_sigma", "end_sigma", "moved_first")


def nearest_places(timesteps: Column, targets: list[float]) -> Column:
    """The 0-based place of the nearest timestep to each target, of equally near ones the first; null for no timesteps."""

    def place(target: float) -> Column:
        gaps = F.transform(timesteps, lambda t: F.abs(t - F.lit(float(target))))
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")

    return F.when(F.size(timesteps) > 0, F.array(*map(place, targets)))


def at_places_and_last(values: Column, places: Column) -> Column:
    """The values at the places, and the last value after them."""
    return F.concat(F.transform(places, lambda p: F.get(values, p)), F.array(F.element_at(values, -1)))


def annealed(value: float, step: int, over: int) -> float:
    """A parameter of the draw on its cosine way to 1, where the draw is uniform; ``over`` = 0 leaves it as it is."""
    return value if over <= 0 else 1.0 + (value - 1.0) * 0.5 * (1.0 + math.cos(math.pi * min(step / over, 1.0)))


def beta_quantile(u: Column, alpha: float, beta: float, points: int = 1 << 14) -> Column:
    """The value below which a Beta(alpha, beta) draw lies with probability ``u``, by interpolating the distribution at
    ``points`` places; batches of Arrow columns."""
    x = (np.arange(points) + 0.5) / points
    weight = np.exp((alpha - 1) * np.log(x) + (beta - 1) * np.log1p(-x))
    below = np.r_[0.0, np.cumsum(weight) / weight.sum()]
    edges = np.arange(points + 1) / points

    @F.pandas_udf("double")
    def quantile(u: pd.Series) -> pd.Series:
        return pd.Series(np.interp(u, below, edges)).where(u.notna())

    return quantile(u)


def draw(ident: Column, kind: str, alpha: float, beta: float, step: int, over: int, seed: str) -> Column:
    """A number in [0, 1) for each row, by hash: uniform, or of a Beta distribution that anneals to it."""
    u = chance(ident, seed)
    if kind == "uniform":
        return u
    if kind == "beta":
        return beta_quantile(u, annealed(alpha, step, over), annealed(beta, step, over))
    raise ValueError(f"{kind!r} is neither uniform nor beta")


def drawn_sections(ident: Column, least: int, most: int, kind: str = "uniform", alpha: float = 1.5, beta: float = 4.0, step: int = 0, over: int = 1000, seed: str = "sections") -> Column:
    """How many sections a sample is given, from ``least`` to ``most``, half-way cases to even."""
    if least == most:
        return F.lit(least)
    t = draw(ident, kind, alpha, beta, step, over, seed)
    return F.least(F.greatest(F.bround(F.lit(least) + t * F.lit(most - least)).cast("int"), F.lit(least)), F.lit(most))


def drawn_timestep(ident: Column, kind: str = "uniform", least: int = 0, most: int = 1000, low: int = 20, high: int = 980, shift: float = 1.0, alpha: float = 4.0, beta: float = 1.5, step: int = 0, over: int = 1000, training: int = STEPS, seed: str = "timestep") -> Column:
    """A timestep between ``low`` and ``high``, drawn on [least, most] and warped by the shift where that is above 1."""
    t = draw(ident, kind, alpha, beta, step, over, seed)
    if kind == "uniform":
        t = t * F.lit(1.0 - 0.001) + F.lit(0.001)
    at = F.lit(least) + t * F.lit(most - least)
    if shift > 1:
        at = shifted_sigma(at / F.lit(float(training)), shift) * F.lit(training)
    return F.bround(F.least(F.greatest(at, F.lit(float(low))), F.lit(float(high)))).cast("bigint")


def ema_decay(step: Column, after: int = 0, most: float = 0.9999, least: float = 0.0, warm: bool = False, gamma: float = 1.0, power: float = 2 / 3) -> Column:
    """The decay of a moving average of parameters: 0 until ``after``, then rising with the step, within [least, most]."""
    n = (F.greatest(F.lit(0), step - F.lit(after + 1))).cast("double")
    rising = 1 - F.pow(1 + n / F.lit(gamma), F.lit(-power)) if warm else (1 + n) / (10 + n)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.least(rising, F.lit(most)), F.lit(least)))
