"""Scores, ratings and the composite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Min-max normalisation, clamped to 0..1; null and NaN stay null."""
    clean = F.when(~F.isnan(score.cast("double")), score.cast("double"))
    return F.when(clean.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (clean - F.lit(low)) / F.lit(high - low))))


def rating(score: Column, kind: Column, thresholds: Column, target: Column | None = None) -> Column:
    """Ladder rating: 10 for the first threshold met, one less for each further one, 1 for none; null for a null score.

    kind: "higher" (score >= threshold), "lower" (score <= threshold), "target" (distance from target <= threshold).
    """
    measure = F.when(kind == "target", F.abs(score - (target if target is not None else F.lit(0.0)))).otherwise(score)
    hit = F.filter(F.sequence(F.lit(0), F.size(thresholds) - 1), lambda i: F.when(kind == "higher", measure >= F.get(thresholds, i)).otherwise(measure <= F.get(thresholds, i)))
    return F.when(score.isNotNull(), F.coalesce(10 - F.get(hit, F.lit(0)), F.lit(1)))


def picked_score(average: Column, drift: Column, compat: bool = False) -> Column:
    """The plain average, or else the drift average. compat: an average of exactly 0 counts as missing."""
    return F.coalesce(F.nullif(average, F.lit(0.0)) if compat else average, drift)


def throughput_score(fps: Column) -> Column:
    """One point per 3.2 frames a second, from 1 to 10."""
    return F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(fps / F.lit(3.2)))).cast("int")


def naturalness(raw: Column) -> Column:
    """A judge's answer of 1..5 as 0..1, clamped; null where it is no number."""
    value = raw.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value), (F.least(F.lit(5.0), F.greatest(F.lit(1.0), value)) - 1) / 4)


def preference_code(label: Column) -> Column:
    """A wins 1, B wins -1, same 0, anything else and null 22."""
    return F.when(label == "A", 1).when(label == "B", -1).when(label == "same", 0).otherwise(22)


def chosen_score(kind: str, raw: Column, norm: Column, rated: Column) -> Column:
    """raw, normalized or rating; any other kind means normalized."""
    return {"raw": raw, "rating": rated.cast("double")}.get(kind, norm)


def percent(value: Column, digits: int = 2) -> Column:
    """A share as text in per cent."""
    return F.concat(F.format_number(value * 100, digits), F.lit("%"))


def z_score(value: Column, mean: float, std: float) -> Column:
    return (value - F.lit(mean)) / F.lit(std)
