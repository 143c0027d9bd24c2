"""Sequence operators: history and target windows, chunks, drift, schedules, retention.

Windows are over one sequence (a video, a user, an order); a frame of fixed width keeps memory per row bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY, TARGET = 19, 9


def left_padded(values: Column, n: int, by: Column) -> Column:
    """The values with as many of ``by`` in front as they lack to n."""
    return F.concat(F.array_repeat(by, F.greatest(F.lit(0), F.lit(n) - F.size(values))), values)


def history_target(df: DataFrame, key: str, order: str, value: str, history: int = HISTORY, target: int = TARGET) -> DataFrame:
    """(key, chunk, history, target): for each full chunk its values and those before, zeros in front of the first ones.

    The order must be unique within the key. A last chunk that is not full is left out.
    """
    seq = W.partitionBy(key).orderBy(order)
    rows = df.select(key, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    seq = W.partitionBy(key).orderBy("_o")
    rows = rows.withColumn("_n", F.row_number().over(seq) - 1)
    rows = rows.withColumn("_h", F.collect_list("_v").over(seq.rowsBetween(-history, -1))).withColumn("_t", F.collect_list("_v").over(seq.rowsBetween(0, target - 1)))
    rows = rows.filter((F.col("_n") % target == 0) & (F.size("_t") == target))
    return rows.select(key, F.floor(F.col("_n") / target).cast("bigint").alias("chunk"), left_padded(F.col("_h"), history, F.lit(0.0)).alias("history"), F.col("_t").alias("target"))


def split_history(history: Column, long: int = 16, mid: int = 2, short: int = 1) -> tuple[Column, Column, Column]:
    """The oldest, the middle and the newest part of a history of long + mid + short values."""
    return F.slice(history, 1, long), F.slice(history, long + 1, mid), F.slice(history, long + mid + 1, short)


def history_dropout(history: Column, kept: int) -> Column:
    """Zeros for all but the newest ``kept`` values."""
    return F.transform(history, lambda x, i: F.when(i < F.size(history) - kept, F.lit(0.0)).otherwise(x))


def dropped_entries(ident: Column, size: int, text: float, image: float, video: float, window: int = TARGET, seed: str = "drop") -> Column:
    """How many of the oldest entries of a history of ``size`` a sample drops, by chance: all (text only), all but the newest
    (an image), or the part before the last whole windows and some of these windows (a video); else none."""
    from cliploom.operators.sampling import chance, pick

    windows = F.lit(size % window) + pick(ident, f"{seed}-windows", F.lit(size // window + 1)) * window
    by = lambda name, share: (F.lit(share) != 0) & (chance(ident, f"{seed}-{name}") <= share)
    return F.when(by("text", text), F.lit(size)).when(by("image", image), F.lit(max(0, size - 1))).when(by("video", video), windows).otherwise(0).cast("int")


def oldest_zeroed(history: Column, dropped: Column) -> Column:
    return F.transform(history, lambda x, i: F.when(i < dropped, F.lit(0.0)).otherwise(x))


def rollout_range(sections: Column, rollout: int, ident: Column, history: int = HISTORY, window: int = TARGET, seed: str | int = 0) -> Column:
    """struct(start, end) of a stretch of ``rollout`` sections, chosen by hash, with the history before it. The query fails
    where there are fewer sections."""
    from cliploom.operators.sampling import pick

    room = sections - F.lit(rollout)
    start = (F.when(room >= 0, pick(ident, seed, room + 1)).otherwise(F.raise_error(F.format_string("%d sections are fewer than %d", sections, F.lit(rollout)))) * window).cast("int")
    return F.struct(start.alias("start"), (start + history + rollout * window).alias("end"))


def interval_steps(intervals: DataFrame, key: str, order: str, length: str, value: str, steps: int) -> DataFrame:
    """(key, section, value): of every section of a key its interval's vector; in the first ``steps`` sections of a later
    interval one on the way from the interval before it. An interval's sections follow from its own bounds, so no section is
    compared with intervals that do not hold it."""
    from cliploom.functions.vectors import lerp

    seq = W.partitionBy(key).orderBy(order)
    rows = schedule(intervals, key, order, length).withColumn("_before", F.lag(value).over(seq)).filter(F.col("ends") > F.col("begins"))
    rows = rows.withColumn("section", F.explode(F.sequence("begins", F.col("ends") - 1)))
    at = (F.col("section") - F.col("begins")) / F.lit(float(max(1, steps - 1)))
    moving = F.col("_before").isNotNull() & (F.col("section") - F.col("begins") < steps)
    return rows.select(key, "section", F.when(moving, lerp(F.col("_before"), F.col(value), at)).otherwise(F.col(value)).alias(value))


def numbered(df: DataFrame, key: str, order: list, name: str = "rn") -> DataFrame:
    """0-based place within the key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def full_chunks(df: DataFrame, key: str, place: str, size: int) -> DataFrame:
    """Adds chunk; rows of a last chunk that is not full fall out."""
    many = F.count(F.lit(1)).over(W.partitionBy(key))
    return df.withColumn("_m", many).withColumn("chunk", F.floor(F.col(place) / size).cast("bigint")).filter(F.col("chunk") < F.floor(F.col("_m") / size)).drop("_m")


def start_end_drift(df: DataFrame, key: str, order: list, value: str, share: float = 0.15, least: int = 1) -> DataFrame:
    """(key, start_mean, end_mean, drift): means of the first and the last ``share`` of each sequence, at least ``least``
    values each, which may overlap, and their distance."""
    up = W.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_a", F.row_number().over(up)).withColumn("_m", F.count(F.lit(1)).over(W.partitionBy(key)))
    n = F.greatest(F.lit(least), F.floor(F.col("_m") * F.lit(share)))
    head = F.avg(F.when(F.col("_a") <= n, F.col(value)))
    tail = F.avg(F.when(F.col("_a") > F.col("_m") - n, F.col(value)))
    return rows.groupBy(key).agg(head.alias("start_mean"), tail.alias("end_mean")).withColumn("drift", F.abs(F.col("start_mean") - F.col("end_mean")))


def pair_differences(df: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Adds diff: the distance from the value before; null for the first of a sequence."""
    return df.withColumn("diff", F.abs(F.col(value) - F.lag(value).over(W.partitionBy(key).orderBy(*order))))


def group_breaks(df: DataFrame, key: str, order: list, group: str) -> DataFrame:
    """Adds breaks: whether ``group`` differs from the row before; true for the first row."""
    before = F.lag(group).over(W.partitionBy(key).orderBy(*order))
    first = F.row_number().over(W.partitionBy(key).orderBy(*order)) == 1
    return df.withColumn("breaks", first | ~before.eqNullSafe(F.col(group)))


def neighbours(df: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Adds previous and next; at the ends the row's own value."""
    seq = W.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(value, 1).over(seq)).withColumn("next", F.lead(value, 1).over(seq)).withColumn("previous", F.coalesce("previous", value)).withColumn("next", F.coalesce("next", value))


def newest(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The n rows of each key that are last in the order given first; what a retention rule keeps."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def latest_checkpoint(names: DataFrame, run: str, name: str) -> DataFrame:
    """(run, name): the final checkpoint of a run if it has one, else the one of the highest step."""
    final, step = F.col(name).endswith("-final").cast("int"), F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint")
    return names.groupBy(run).agg(F.max_by(name, F.struct(final, step, name)).alias("latest"))


def schedule(df: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """Adds begins and ends: each entry's half-open interval on the running total of lengths."""
    total = F.sum(length).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("ends", total).withColumn("begins", F.col("ends") - F.col(length))


def worker_of(place: Column, total: Column, workers: int) -> Column:
    """The worker that holds a place when the whole is cut into equal ranges, the last one shorter."""
    return F.floor(place / F.ceil(total / workers)).cast("int")


def every_second(values: Column, start: int = 0) -> Column:
    return F.filter(values, lambda x, i: i % 2 == start)


def sections(frames: Column, size: int = 33) -> Column:
    return F.greatest(F.lit(1), F.ceil(frames / size)).cast("int")
