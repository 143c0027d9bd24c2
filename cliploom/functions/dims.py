"""Dimension tables: fixed values of the metric, shape and action vocabularies, as rows for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Weights of the metrics in the composite rating.
WEIGHTS_SHORT = {"aesthetic": 0.10, "motion_amplitude": 0.10, "motion_smoothness": 0.10, "semantic": 0.35, "naturalness": 0.35}
WEIGHTS_LONG = {
    "aesthetic": 0.03, "motion_amplitude": 0.03, "motion_smoothness": 0.03, "semantic": 0.255, "naturalness": 0.255,
    "drifting_aesthetic": 0.099, "drifting_motion_smoothness": 0.099, "drifting_semantic": 0.099, "drifting_naturalness": 0.099,
}

# Rating ladders. The first threshold met gives 10, the next 9, and so on; none gives 1.
LADDERS = {
    "aesthetic": ("higher", [0.70, 0.65, 0.60, 0.55, 0.50, 0.45, 0.40, 0.35, 0.30]),
    "motion_amplitude": ("higher", [0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10, 0.05]),
    "motion_smoothness": ("higher", [0.99, 0.98, 0.97, 0.96, 0.95, 0.94, 0.93, 0.92, 0.91]),
    "semantic": ("higher", [0.30, 0.29, 0.28, 0.27, 0.26, 0.25, 0.24, 0.23, 0.22]),
    "naturalness": ("higher", [0.65, 0.60, 0.55, 0.50, 0.45, 0.40, 0.30, 0.25, 0.20]),
    "drifting_aesthetic": ("lower", [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09]),
    "drifting_motion_smoothness": ("lower", [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09]),
    "drifting_semantic": ("lower", [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09]),
    "drifting_naturalness": ("lower", [0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18, 0.20, 0.22]),
}
#: The long evaluation's ladder for this metric is not monotone: ratings 3 and 2 cannot be reached.
LONG_AESTHETIC = [0.70, 0.65, 0.60, 0.55, 0.50, 0.45, 0.40, 0.45, 0.40]

# The names that result files give to metrics.
ALIASES = {
    "aesthetic_score": "aesthetic", "motion_amplitude_score": "motion_amplitude", "motion_smoothness_score": "motion_smoothness",
    "naturalness_score": "naturalness", "semantic_score": "semantic", "drift_aesthetic_score": "drifting_aesthetic",
    "drift_motion_smoothness_score": "drifting_motion_smoothness", "drift_naturalness_score": "drifting_naturalness",
    "drift_semantic_score": "drifting_semantic",
}

# Fixed values: (height, width) of the resolution buckets, in the order that decides ties.
RESOLUTIONS = [(768, 320), (768, 384), (640, 384), (768, 512), (576, 448), (512, 512), (448, 576), (512, 768), (384, 640), (384, 768), (320, 768)]
# Length buckets by stride.
LENGTHS_1 = [501, 481, 461, 441, 421, 401, 381, 361, 341, 321, 301, 281, 261, 241, 221, 193, 181, 161, 141, 121, 101, 81, 61, 41, 21]
LENGTHS_2 = [193, 177, 161, 156, 145, 133, 129, 121, 113, 109, 97, 85, 81, 73, 65, 61, 49, 37, 25]

# The action vocabulary.
KEYS = ["W", "A", "S", "D", "W+A", "W+D", "S+A", "S+D", "None"]
MOUSE = ["→", "←", "↑", "↓", "↑→", "↑←", "↓→", "↓←", "·"]
IDLE = ("None", "·")


def ladder(metric: str, is_long: bool) -> tuple[str, list[float]]:
    kind, thresholds = LADDERS[metric]
    return kind, LONG_AESTHETIC if is_long and metric == "aesthetic" else thresholds


def rules(spark: SparkSession, is_long: bool) -> DataFrame:
    """(metric, weight, kind, thresholds) of an evaluation; nine rows at most."""
    weights = WEIGHTS_LONG if is_long else WEIGHTS_SHORT
    return spark.createDataFrame([(m, w, *ladder(m, is_long)) for m, w in weights.items()], "metric string, weight double, kind string, thresholds array<double>")


def vocabulary(spark: SparkSession) -> DataFrame:
    """(action_id, keys, mouse): the 81 actions, keys outermost."""
    keys = spark.createDataFrame([(i, k) for i, k in enumerate(KEYS)], "ki int, keys string")
    mouse = spark.createDataFrame([(i, m) for i, m in enumerate(MOUSE)], "mi int, mouse string")
    return keys.crossJoin(mouse).selectExpr("ki * 9 + mi AS action_id", "keys", "mouse")


def sql_values(rows: list[tuple]) -> str:
    """Rows as the body of a VALUES list."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(lit, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
