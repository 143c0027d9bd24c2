"""Set operations, run comparison and differences of nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def only_in_first(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def run_pairs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, first, second, place): the outputs of two runs under the same keys side by side, in order of the keys."""
    from cliploom.operators.ordering import positions

    both = a.select(*keys, F.col(value).alias("first")).join(b.select(*keys, F.col(value).alias("second")), keys)
    return positions(both, [F.col(k) for k in keys] + [F.col("first"), F.col("second")], "place")


def all_by_name(*parts: DataFrame) -> DataFrame:
    """UNION ALL by column name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_two_steps(runs: DataFrame, index: str, step: str) -> DataFrame:
    """(index, first, second) of indices that occur at two steps or more."""
    steps = F.array_sort(F.collect_set(step))
    return runs.groupBy(index).agg(steps.alias("s")).filter(F.size("s") >= 2).select(index, F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"))


def differences(a: DataFrame, b: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """(path, left, right, kind) of paths that only one side has or that differ; a null value counts as a value."""
    l, r = (d.select(path, F.col(value).alias(n), F.lit(True).alias("_" + n)) for d, n in ((a, "left"), (b, "right")))
    both = l.join(r, path, "full_outer")
    kind = F.when(F.col("_right").isNull(), "only left").when(F.col("_left").isNull(), "only right").when(~F.col("left").eqNullSafe(F.col("right")), "differs")
    return both.withColumn("kind", kind).filter("kind is not null").select(path, "left", "right", "kind")


def without_ignored(diff: DataFrame, ignored: list[str], path: str = "path") -> DataFrame:
    """Differences but those whose full path or last part is in the list."""
    if not ignored:
        return diff
    return diff.filter(~F.col(path).isin(ignored) & ~F.substring_index(path, ".", -1).isin(ignored))


def drift_or_fail(diff: DataFrame, what: str) -> DataFrame:
    """The query fails with the first difference it meets; without one the result is empty."""
    return diff.filter(F.raise_error(F.concat(F.lit(what + ": "), F.col("path"))).cast("boolean"))


def flattened(document: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(path, value) rows of a configuration held by the driver; lists are compared whole."""
    import json

    rows: list[tuple[str, str]] = []
    for key, value in document.items():
        if isinstance(value, dict):
            rows += flattened(value, f"{prefix}{key}.")
        else:
            rows.append((f"{prefix}{key}", json.dumps(value, sort_keys=True)))
    return rows


def tolerant_union(points: DataFrame, targets: DataFrame, column: str, tolerance: float = 1e-4) -> DataFrame:
    """Points and those targets that no point is within the tolerance of.

    Points and targets fall into steps of the tolerance, so the test is a join on a step and its two neighbours.
    """
    step = F.floor(F.col(column) / F.lit(tolerance)).cast("bigint")
    near = points.select(F.col(column).alias("_p"), F.explode(F.array(step - 1, step, step + 1)).alias("_s"))
    kept = targets.withColumn("_s", step).alias("t").join(near.alias("n"), (F.col("t._s") == F.col("n._s")) & (F.abs(F.col(f"t.{column}") - F.col("n._p")) < tolerance), "left_anti")
    return points.select(column).unionByName(kept.select(column))


def entries_where(values: Column, test) -> Column:
    """The entries of a map whose key passes."""
    return F.map_filter(values, lambda k, _: test(k))


def without_repeated_prefix(values: Column, prefix: str) -> Column:
    """Keys of a map without leading repetitions of the prefix; the first of keys that become equal stays."""
    pairs = F.transform(F.map_entries(values), lambda e: F.struct(F.regexp_replace(e["key"], f"^(?:{prefix})+", "").alias("key"), e["value"].alias("value")))
    firsts = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(firsts)
