"""Stateful sequence operators in batch form: moving averages, drift flags, bounded buffers and admission masks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.operators.ordering import positions, with_totals
from cliploom.operators.sampling import chance, pick, shuffle_key
from cliploom.session import materialize


def composed(a: np.ndarray, b: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For steps x -> a x + b (one row each, b with a column per value) the composition of all steps since the last begin."""
    a, b, whole = a.copy(), b.copy(), begins.copy()
    reach = 1
    while not whole.all():
        more = ~whole[reach:]
        b[reach:][more] += a[reach:][more, None] * b[:-reach][more]
        # the right sides are those of before this turn
        a[reach:][more] *= a[:-reach][more].copy()
        whole[reach:] |= whole[:-reach].copy()
        reach *= 2
    return a, b


def moving_averages(df: DataFrame, key: str, order: str, values: dict[str, str], rho: float) -> DataFrame:
    """(key, order, and per item of ``values`` the column and its exponential moving average under the item's name): rho
    times the one before plus (1 - rho) times the value, the first being the value itself. Rows with a null value fall out.

    A step is linear, so steps compose. Rows are range-partitioned by key and order; a task composes the steps of each key
    within its range, the ranges of a key are joined up from one row each, and every row gets its range's start. A key with
    most of the rows is spread over many tasks.
    """
    names, columns = list(values), list(values.values())
    rows = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns))).dropna(subset=[f"_v{i}" for i in range(len(columns))])
    placed = rows.repartitionByRange("_k", "_o").sortWithinPartitions("_k", "_o").withColumn("_p", F.spark_partition_id())
    v, g = [f"_v{i}" for i in range(len(columns))], [f"_g{i}" for i in range(len(columns))]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, a0, b0 = None, 1.0, np.zeros(len(v))
        for f in frames:
            if not len(f):
                continue
            k = f["_k"].to_numpy()
            begins = np.r_[True, k[1:] != k[:-1]]
            a, b = composed(np.full(len(f), rho), f[v].to_numpy() * (1 - rho), begins)
            if k[0] == last:
                head = slice(0, int(np.flatnonzero(np.r_[begins[1:], True])[0]) + 1)
                b[head] += a[head, None] * b0
                a[head] *= a0
            last, a0, b0 = k[-1], a[-1], b[-1].copy()
            f["_a"] = a
            for i, c in enumerate(g):
                f[c] = b[:, i]
            yield f

    kind = placed.schema
    folded = materialize(placed.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields) + ", _a double, " + ", ".join(f"{c} double" for c in g)), "folded")
    end = F.max_by(F.struct("_a", *g), F.col("_o"))
    parts = folded.groupBy("_k", "_p").agg(end.alias("e"), F.min_by(F.struct(*v), F.col("_o")).alias("f"))
    # the few ranges of a key, one after the other; before its first one stands its first value
    ranges = F.array_sort(F.collect_list(F.struct("_p", "e", "f")))
    begin = lambda r: F.array(*(F.get(r, F.lit(0))["f"][c] for c in v))
    after = lambda x, e: F.transform(F.array(*(e[c] for c in g)), lambda b, i: F.get(x, i) * e["_a"] + b)
    starts = parts.groupBy("_k").agg(ranges.alias("r"))
    step = lambda acc, x: F.struct(after(acc["x"], x["e"]).alias("x"), F.concat(acc["all"], F.array(F.struct(x["_p"].alias("p"), acc["x"].alias("x")))).alias("all"))
    none = F.slice(F.array(F.struct(F.lit(0).alias("p"), F.array(*(F.lit(0.0) for _ in v)).alias("x"))), 1, 0)
    starts = starts.select("_k", F.explode(F.aggregate("r", F.struct(begin(F.col("r")).alias("x"), none.alias("all")), step, lambda acc: acc["all"])).alias("s")).select("_k", F.col("s.p").alias("_p"), F.col("s.x").alias("_s"))
    out = folded.join(starts, ["_k", "_p"])
    return out.select(F.col("_k").alias(key), F.col("_o").alias(order), *(F.col(v[i]).alias(c) for i, c in enumerate(columns)), *((F.col("_a") * F.get("_s", F.lit(i)) + F.col(g[i])).alias(n) for i, n in enumerate(names)))


def moving_average(df: DataFrame, key: str, order: str, value: str, rho: float, name: str = "ema") -> DataFrame:
    """(key, order, name): the moving average of one column, as ``moving_averages`` makes it."""
    return moving_averages(df, key, order, {name: value}, rho).select(key, order, name)


def drift_flags(df: DataFrame, key: str, order: str, mean: str, variance: str, rho: float = 0.9, delta: float = 0.15, compat: bool = False) -> DataFrame:
    """(key, order, drift): whether a chunk's mean and variance are both more than ``delta`` from the moving averages.

    The averages of the chunks before are compared with; the first chunk never drifts. compat: the chunk is averaged in
    before it is compared, which makes every distance smaller by the factor rho. Rows with a null mean or variance fall out.
    """
    out = moving_averages(df, key, order, {"_m": mean, "_s": variance}, rho)
    # the average before a step follows from the one after it
    before = lambda after, value: F.col(after) if compat else (F.col(after) - F.lit(1 - rho) * F.col(value)) / F.lit(rho)
    far = [F.abs(F.col(c) - before(a, c)) > delta for a, c in (("_m", mean), ("_s", variance))]
    return out.select(key, order, (far[0] & far[1]).alias("drift"))


def similarity_buffer(df: DataFrame, key: str, order: str, ident: str, vector: str, size: int) -> DataFrame:
    """(key, slot, ident): what a buffer of ``size`` vectors holds in the end when a new one takes the place of the most
    similar one once the buffer is full; the first of equally similar ones goes.

    What is replaced depends on all that came before, so a key's rows pass through one task in order and a key with a third
    of all rows takes as long as these rows do; memory is one buffer, an array that is replaced in place.
    """
    rows = df.select(F.col(key).cast("string").alias("_k"), F.col(ident).cast("bigint").alias("_i"), F.col(order).alias("_o"), F.col(vector).cast("array<double>").alias("_v")).filter("_v is not null")
    placed = rows.repartition("_k").sortWithinPartitions("_k", "_o", "_i").select("_k", "_i", "_v")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ids, held = None, np.zeros(size, dtype=np.int64), None
        filled = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"_k": [current] * filled, "slot": np.arange(filled), "_i": ids[:filled].copy()})

        for f in frames:
            keys, idents, vectors = f["_k"].tolist(), f["_i"].to_numpy(), f["_v"].tolist()
            for k, i, v in zip(keys, idents, vectors):
                if k != current:
                    if filled:
                        yield out()
                    current, filled, held = k, 0, np.empty((size, len(v)))
                if filled < size:
                    at, filled = filled, filled + 1
                else:
                    gap = held - v
                    at = int(np.argmin(np.sqrt(np.einsum("ij,ij->i", gap, gap))))
                ids[at], held[at] = i, v
        if filled:
            yield out()

    kept = placed.mapInPandas(run, "_k string, slot int, _i bigint")
    return kept.select(F.col("_k").alias(key), "slot", F.col("_i").alias(ident))


def random_buffer(df: DataFrame, key: str, order: str, ident: str, size: int, seed: str | int = 0) -> DataFrame:
    """(key, slot, ident): the same buffer when a new row takes a place chosen by the hash of its id. The places are known
    beforehand, so the last row of each place holds it; ``order`` is unique within the key."""
    rows = df.select(key, F.col(ident).alias("_i"), F.col(order).alias("_o"))
    # only the first ``size`` rows of a key need their number; every task keeps no more of a key than that
    head = rows.withColumn("slot", F.row_number().over(W.partitionBy(key).orderBy("_o")) - 1).filter(F.col("slot") < size)
    last = head.groupBy(F.col(key).alias("_k")).agg(F.max("_o").alias("_last"))
    later = rows.join(last, F.col(key).eqNullSafe(F.col("_k"))).filter(F.col("_o") > F.col("_last")).withColumn("slot", pick(F.col("_i"), seed, F.lit(size)).cast("int"))
    held = head.select(key, "slot", "_i", "_o").unionByName(later.select(key, "slot", "_i", "_o"))
    return held.groupBy(key, "slot").agg(F.max_by("_i", "_o").alias(ident))


def intensity(ident: Column, factor: float, seed: str = "intensity") -> Column:
    """What a picked error is multiplied with, by chance between 1 - factor and 1 + factor."""
    return F.lit(1 - factor) + chance(ident, seed) * F.lit(2 * factor)


def any_buffer_pick(rows: DataFrame, ident: str, held: DataFrame, held_id: str, seed: str | int = 0) -> DataFrame:
    """(ident, held_id): for each row an entry of all buffers together, whatever its key, by hash."""
    placed = positions(held.select(held_id), [F.col(held_id)], "_p")
    wanted = with_totals(rows.select(ident), placed.agg(F.count(F.lit(1)).alias("_n"))).filter("_n > 0").withColumn("_p", pick(F.col(ident), seed, F.col("_n")))
    return wanted.join(placed, "_p").select(ident, held_id)


def buffer_pick(df: DataFrame, key: str, ident: str, seed: str | int = 0) -> DataFrame:
    """One row of each key, by hash."""
    return df.groupBy(key).agg(F.min_by(ident, F.struct(shuffle_key(F.col(ident), seed), F.col(ident))).alias(ident))


def error_masks(ident: Column, latent: float, noise: float, target: float, clean: float, seed: str = "mask") -> list[Column]:
    """Whether a sample's latent, noise and target get an error; a clean sample gets none."""
    clean_one = chance(ident, f"{seed}-clean") < clean
    return [((chance(ident, f"{seed}-{n}") < p) & ~clean_one).alias(n) for n, p in (("latent", latent), ("noise", noise), ("target", target))] + [clean_one.alias("clean")]


def admitted(worker: Column, step: Column, own: int, warmup: int, is_clean: Column, ident: Column, share: float, seed: str = "admit") -> Column:
    """Whether a worker's buffer takes a sample: from all workers until the warm-up ends, then its own only; clean samples
    by chance."""
    return ((step < warmup) | (worker == own)) & (~is_clean | (chance(ident, seed) < share))
