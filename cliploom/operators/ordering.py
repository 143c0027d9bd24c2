"""Global positions without a global window: rows are range-partitioned, partitions are counted, and each row's place is
its partition's offset plus its place there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.session import materialize

_LOW = (1 << 33) - 1


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the 0-based place of each row in the order. Ties should be broken by the order; equal rows may take either
    place. Only one row per partition is gathered."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per partition of the table written above
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(_LOW))).drop("_part", "_before", "_id")


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """The rows with the columns of a one-row table, such as an overall count, by an equi-join on a constant."""
    one = totals.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")
