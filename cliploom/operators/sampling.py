"""Deterministic sampling, sharding and batching.

Random choices of the training loaders are replaced by the order of md5(id:seed): the same selection on every engine and
every run, uniform over ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.functions.captions import stripped
from cliploom.operators.ordering import positions, with_totals


def shuffle_key(ident: Column, seed: str | int, epoch: Column | int = 0) -> Column:
    """Sorting by it shuffles; another epoch gives another order."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat(ident.cast("string"), F.lit(":"), F.lit(str(seed)), F.lit(":"), epoch.cast("string")))


def pick(ident: Column, seed: str | int, n: Column) -> Column:
    """A number from 0 to n - 1, by hash."""
    return F.conv(F.substring(shuffle_key(ident, seed), 1, 8), 16, 10).cast("bigint") % n


def chance(ident: Column, seed: str | int) -> Column:
    """A number in [0, 1), by hash."""
    return F.conv(F.substring(shuffle_key(ident, seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def shard(df: DataFrame, order: list[Column], rank: int, world: int) -> DataFrame:
    """Every world-th row from the rank-th on."""
    return positions(df, order, "_p").filter(F.col("_p") % world == rank).drop("_p")


def padded_shards(df: DataFrame, order: list[Column], world: int, drop_last: bool = False) -> DataFrame:
    """Adds rank and place: rows dealt out in turn. The rows that lack to a multiple of ``world`` are the first ones once
    more; with drop_last the rows beyond a multiple fall out instead."""
    placed = positions(df, order, "place")
    placed = with_totals(placed, placed.agg(F.count(F.lit(1)).alias("_n")))
    if drop_last:
        out = placed.filter(F.col("place") < F.col("_n") - F.col("_n") % world)
    else:
        lack = (F.lit(world) - F.col("_n") % world) % world
        again = placed.filter(F.col("place") < lack).withColumn("place", F.col("place") + F.col("_n"))
        out = placed.unionByName(again)
    return out.withColumn("rank", (F.col("place") % world).cast("int")).drop("_n")


def ratio_sample(df: DataFrame, group: str, ident: str, ratios: dict[str, float], total: int, seed: str | int = 0) -> DataFrame:
    """Adds copy: of each listed group its share of ``total`` rows, at least one; a group that is too small is used in whole
    rounds and then in part. Groups that are not listed stay whole. Always from all rows, so epochs do not add up."""
    weight = sum(ratios.values())
    wanted = {g: max(1, int(total * r / weight)) for g, r in ratios.items()}
    target = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv))[F.col(group)] if wanted else F.lit(None).cast("int")
    # within a group by hash; a group's sort is split by the first digit so that no task holds a whole group
    ranked = _ranked(df, group, ident, seed).withColumn("_t", F.coalesce(target.cast("bigint"), F.col("_size")))
    rounds = F.ceil((F.col("_t") - F.col("_rank")) / F.col("_size")).cast("int")
    return ranked.withColumn("_rounds", rounds).filter("_rounds > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_rounds")))).drop("_rank", "_size", "_t", "_rounds")


def _ranked(df: DataFrame, group: str, ident: str, seed: str | int) -> DataFrame:
    """Adds _rank, the 0-based place in the group's shuffled order, and _size. Ranks are counted within the 256 parts that
    the first two digits of the hash make, and the parts are totalled."""
    keyed = df.withColumn("_h", shuffle_key(F.col(ident), seed)).withColumn("_part", F.substring("_h", 1, 2))
    parts = keyed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    over = W.partitionBy(group)
    parts = parts.select(group, "_part", F.sum("_n").over(over).alias("_size"), F.coalesce(F.sum("_n").over(over.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy(group, "_part").orderBy("_h", ident)) - 1
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_size", "_before")
    out = keyed.withColumn("_inner", inner).join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("_rank", F.col("_before") + F.col("_inner")).drop("_h", "_part", "_inner", "_before", "_g", "_p")


def equal_sample(df: DataFrame, group: str, ident: str, seed: str | int = 0) -> DataFrame:
    """As many rows of every group as the smallest one has."""
    ranked = _ranked(df, group, ident, seed)
    least = df.groupBy(group).count().agg(F.min("count").alias("_least"))
    return with_totals(ranked, least).filter(F.col("_rank") < F.col("_least")).drop("_rank", "_size", "_least")


def batches(df: DataFrame, bucket: str, ident: str, size: int, seed: str | int = 0, drop_last: bool = True) -> DataFrame:
    """Adds batch (within the bucket) and batch_key, by which the batches of all buckets are mixed. All rows of a batch are
    of one bucket."""
    out = _ranked(df, bucket, ident, seed).withColumn("batch", F.floor(F.col("_rank") / size).cast("bigint"))
    if drop_last:
        out = out.filter(F.col("batch") < F.floor(F.col("_size") / size))
    return out.withColumn("batch_key", shuffle_key(F.concat_ws("/", F.col(bucket).cast("string"), F.col("batch").cast("string")), seed)).drop("_rank", "_size")


def batch_counts(df: DataFrame, bucket: str, size: int, groups: int, drop_last: bool) -> DataFrame:
    """(bucket, samples, batches) that every one of ``groups`` workers sees."""
    part = F.floor if drop_last else F.ceil
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("samples")).withColumn("batches", part(part(F.col("samples") / groups) / size).cast("bigint"))


def distinct_prompts(df: DataFrame, text: str, limit: int | None, seed: str | int = 0) -> DataFrame:
    """Distinct trimmed non-blank texts in shuffled order, at most ``limit`` of them."""
    rows = df.select(stripped(F.col(text)).alias("prompt")).filter("prompt <> ''").distinct().orderBy(shuffle_key(F.col("prompt"), seed), "prompt")
    return rows if limit is None else rows.limit(limit)


def first_by_hash(df: DataFrame, ident: str, n: int, seed: str | int = 0) -> DataFrame:
    """n rows chosen by hash; every task keeps its n best, so no table is sorted as a whole."""
    return df.orderBy(shuffle_key(F.col(ident), seed), ident).limit(n)


def remaining_sample(work: DataFrame, done: DataFrame, key: str, order: list[str], most: int, seed: str | int = 0) -> DataFrame:
    """Work whose key is not done yet, at most ``most`` rows of it by hash (all for 0), with ``position`` in the given order."""
    left = work.join(done.select(key), key, "left_anti")
    if most <= 0:
        return positions(left, [F.col(c) for c in order])
    return first_by_hash(left, key, most, seed).withColumn("position", F.row_number().over(W.orderBy(*order)) - 1)  # at most ``most`` rows


def substituted(df: DataFrame, ident: str, bucket: str, good: Column, seed: str | int = 0) -> DataFrame:
    """(ident, used): every row by itself if it is good, else by a good row of its bucket, chosen by hash; null where the
    bucket has none. Good rows are numbered within parts of their bucket, so no bucket is gathered."""
    rows = df.select(ident, bucket, good.alias("_good"))
    fine = _ranked(rows.filter("_good"), bucket, ident, seed).select(F.col(bucket).alias("_b"), F.col("_rank").alias("_r"), F.col(ident).alias("_used"))
    many = rows.filter("_good").groupBy(F.col(bucket).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    broken = rows.filter(~F.coalesce("_good", F.lit(False)))
    wanted = broken.join(many, F.col(bucket).eqNullSafe(F.col("_b")), "left").withColumn("_r", pick(F.col(ident), seed, F.col("_n"))).drop("_b")
    replaced = wanted.join(fine, F.col(bucket).eqNullSafe(F.col("_b")) & (wanted["_r"] == fine["_r"]), "left").select(ident, F.col("_used").alias("used"))
    return rows.filter("_good").select(ident, F.col(ident).alias("used")).unionByName(replaced)


def section_choice(sections: Column, chosen: Column, ident: Column, seed: str | int = 0) -> Column:
    """A sorted choice of ``chosen`` section numbers, without repetition."""
    keyed = F.transform(F.sequence(F.lit(0), sections - 1), lambda s: F.struct(shuffle_key(F.concat_ws("/", ident.cast("string"), s.cast("string")), seed).alias("h"), s.alias("s")))
    return F.array_sort(F.transform(F.slice(F.array_sort(keyed), F.lit(1), chosen), lambda k: k["s"]))


def without_caption(value: Column, ident: Column, share: float, seed: str | int = 0) -> Column:
    """The value, or zeros for a share of the rows."""
    return F.when(chance(ident, seed) < share, F.transform(value, lambda x: x * 0)).otherwise(value)
