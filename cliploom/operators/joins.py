"""Joins and lookups of the data plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.functions import dims


def existing(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the files."""
    return rows.join(files.select(key), key, "left_semi")


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose output is not there yet; rows with a null key are work too."""
    return work.join(done.select(key), key, "left_anti")


def chunk_labels(videos: DataFrame, segments: DataFrame, chunk: int = 33) -> DataFrame:
    """(video, chunk, keys, mouse): the action of each chunk of (video, chunks).

    A chunk is labelled by the segment that holds its middle frame, ends included; of several the one that starts first,
    then the smallest seg_id; of none the idle action. Segments are first cut into the chunks whose middle they hold, so
    the join is an equi-join on (video, chunk) and no interval is compared with points it does not hold.
    """
    middle = chunk // 2
    first = F.ceil((F.col("start_frame") - middle) / F.lit(float(chunk)))
    last = F.floor((F.col("end_frame") - middle) / F.lit(float(chunk)))
    held = segments.filter("video is not null and start_frame is not null and end_frame is not null").select("video", "seg_id", "start_frame", "action_keys", "action_mouse", F.greatest(first, F.lit(0)).alias("a"), last.alias("b")).filter("a <= b")
    held = held.select("video", "seg_id", "start_frame", "action_keys", "action_mouse", F.explode(F.sequence("a", "b")).alias("chunk"))
    best = held.groupBy("video", "chunk").agg(F.min_by(F.struct("action_keys", "action_mouse"), F.struct("start_frame", "seg_id")).alias("s"))
    points = videos.filter("chunks > 0").select("video", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    out = points.join(best, ["video", "chunk"], "left")
    return out.select("video", "chunk", F.coalesce("s.action_keys", F.lit(dims.IDLE[0])).alias("keys"), F.coalesce("s.action_mouse", F.lit(dims.IDLE[1])).alias("mouse"))


def tiered_names(rows: DataFrame, names: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Adds resolved and tier: the key itself if it is a name, else its first two "_" parts if these are, else the key."""
    known = names.select(F.col(name).alias("_n")).distinct()
    short = F.substring_index(key, "_", 2)
    out = rows.join(known, rows[key] == known["_n"], "left").withColumnRenamed("_n", "_exact")
    known2 = known.withColumnRenamed("_n", "_m")
    out = out.join(known2, (short == known2["_m"]) & F.col("_exact").isNull(), "left")
    tier = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_m").isNotNull(), "short").otherwise("none")
    return out.withColumn("resolved", F.coalesce("_exact", "_m", key)).withColumn("tier", tier).drop("_exact", "_m")


def by_precedence(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """One row per key out of several sources: an earlier source wins, within one the row last in ``order``."""
    marked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    both = marked[0]
    for s in marked[1:]:
        both = both.unionByName(s)
    first = W.partitionBy(key).orderBy("_rank", F.col(order).desc())
    return both.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_rank")


def unique_or_fail(df: DataFrame, key: str, what: str) -> DataFrame:
    """The rows unchanged; the query fails with ``what`` where a key is there twice."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def with_cached(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Every wanted key once, with reuse = whether its result is cached."""
    return wanted.select(key).distinct().join(cached.select(key).distinct().withColumn("_c", F.lit(True)), key, "left").select(key, F.coalesce("_c", F.lit(False)).alias("reuse"))


def with_action_ids(rows: DataFrame, keys: str = "action_keys", mouse: str = "action_mouse") -> DataFrame:
    """Adds action_id by the 81-row vocabulary; pairs outside of it and nulls have the idle action's."""
    vocabulary = dims.vocabulary(rows.sparkSession).select(F.col("keys").alias(keys), F.col("mouse").alias(mouse), "action_id")
    default = dims.KEYS.index(dims.IDLE[0]) * 9 + dims.MOUSE.index(dims.IDLE[1])
    return rows.join(F.broadcast(vocabulary), [keys, mouse], "left").withColumn("action_id", F.coalesce("action_id", F.lit(default)))


def nearest(value: Column, grid: list[float]) -> Column:
    """struct(place, point) of the nearest grid point; of equally near ones the first. The grid is a fixed schedule."""
    options = [F.struct(F.abs(value - F.lit(float(g))).alias("d"), F.lit(i).alias("place"), F.lit(float(g)).alias("point")) for i, g in enumerate(grid)]
    best = F.array_min(F.array(*options))
    return F.when(value.isNotNull(), F.struct(best["place"].alias("place"), best["point"].alias("point")))


def full_resolution_path(path: Column, height: Column, width: Column) -> Column:
    """The path of the full-size sample, of ``height`` x ``width``, that a half- or quarter-size one was made of: without the
    folder of the smaller size and with the full size in the name."""
    out = F.replace(F.replace(path, F.lit("/mid"), F.lit("")), F.lit("/low"), F.lit(""))
    full = F.format_string("%d_%d", height, width)
    for part in (2, 4):
        out = F.replace(out, F.format_string("%d_%d", F.floor(height / part).cast("int"), F.floor(width / part).cast("int")), full)
    return out


def repeated_names(df: DataFrame, group: str, name: Column) -> DataFrame:
    """(group, name, times) of names that a group lists more than once."""
    return df.select(group, name.alias("name")).groupBy(group, "name").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
