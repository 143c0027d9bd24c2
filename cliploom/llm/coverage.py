"""Problem 3: a subset of given size that covers the variety of a collection.

Method: Hilbert-curve systematic selection. A record's words are projected to a few features, these are quantised so that
every step of a feature holds about as many records, and the cells of the grid are numbered along a Hilbert curve. The
distinct cells are sorted globally, evenly spaced ones are chosen, and the best record of each is taken. A large group of
similar records fills few cells, so it gives few records. A prefix of a curve number is a coarser cell: the curve is cut
at the shortest prefix with enough distinct cells. If even the finest cells are fewer than the records wanted, every cell
gives its best, then its second best, and so on, the last of these rounds being chosen evenly again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.session import materialize, spread, table

FEATURES = 6
BITS = 5
#: Cells numbered within one task.
BIN_BITS = 12


def word_features(df: DataFrame, id_col: str, entries_col: str, penalty: Column) -> DataFrame:
    """(id, penalty, f0..): the mean direction of a record's distinct words, each word having a fixed pseudo-random one.

    Words are runs of letters and digits in lower case. Records without a word and null ids have no features and are not
    selected. ``penalty`` ranks the records of a cell, the smallest being the best.
    """
    source = df.select(df[id_col].cast("bigint").alias("id"), penalty.cast("bigint").alias("penalty"), F.lower(F.concat_ws(" ", df[entries_col])).alias("text")).filter("id is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[str, np.ndarray] = {}
        for batch in batches:
            clean = pc.replace_substring_regex(batch.column(2), r"[^\pL\pN]+", " ")
            lists = pc.split_pattern(pc.utf8_trim_whitespace(clean), " ")
            flat = lists.flatten()
            owner = np.asarray(pc.list_parent_indices(lists))
            coded = flat.dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(directions) > 1 << 18:
                directions.clear()
            for w in words:
                if w not in directions:
                    directions[w] = _direction(w)
            table_of = np.array([directions[w] for w in words]).reshape(-1, FEATURES)
            code = np.asarray(coded.indices)
            pairs = np.unique(owner.astype(np.int64) * max(1, len(words)) + code)
            who, what = pairs // max(1, len(words)), pairs % max(1, len(words))
            real = np.array([w != "" for w in words], bool)[what]
            who, what = who[real], what[real]
            n = np.bincount(who, minlength=batch.num_rows)
            sums = np.stack([np.bincount(who, weights=table_of[what, k], minlength=batch.num_rows) for k in range(FEATURES)], axis=1)
            keep = n > 0
            values = sums[keep] / np.sqrt(n[keep])[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), *(pa.array(values[:, k]) for k in range(FEATURES))], names=["id", "penalty", *(f"f{k}" for k in range(FEATURES))])

    return spread(source).mapInArrow(run, "id bigint, penalty bigint, " + ", ".join(f"f{k} double" for k in range(FEATURES)))


def _direction(word: str) -> np.ndarray:
    import xxhash

    raw = b"".join(xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"), seed=s) for s in range(FEATURES))
    return np.frombuffer(raw, dtype=np.uint64).astype(np.float64) / 2.0**63 - 1.0


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n x dimensions, values below 2**bits).

    The coordinates are turned into the curve's transposed form one bit plane after the other, from the top: where a
    coordinate has the plane's bit, the lower bits of the first are inverted, otherwise its lower bits are exchanged with
    the first's. A Gray decoding and the interleaving of the bits give the place.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        bit, lower = np.int64(1 << plane), np.int64((1 << plane) - 1)
        for i in range(dims):
            has = (x[i] & bit) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & lower)
            x[0] ^= np.where(has, lower, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] & (1 << plane)) != 0, (1 << plane) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> plane) & 1)
    return place


def curve_cells(features: DataFrame, bits: int = BITS) -> DataFrame:
    """(id, penalty, place): quantises each feature at the quantiles of a normal distribution with the feature's mean and
    deviation over all records, and numbers the cells along the curve."""
    names = [f"f{k}" for k in range(FEATURES)]
    stats = features.agg(*(F.avg(n).alias(f"m{n}") for n in names), *(F.stddev_pop(n).alias(f"d{n}") for n in names)).first()
    mean = np.array([stats[f"m{n}"] or 0.0 for n in names])
    spread = np.array([stats[f"d{n}"] or 1.0 for n in names])
    edges = np.array([NormalDist().inv_cdf(i / 2**bits) for i in range(1, 2**bits)])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scaled = (f[names].to_numpy() - mean) / spread
            yield pd.DataFrame({"id": f["id"], "penalty": f["penalty"], "place": hilbert_index(np.searchsorted(edges, scaled, side="right"), bits)})

    return features.mapInPandas(run, "id bigint, penalty bigint, place bigint")


def _prefix_length(places: DataFrame, wanted: int, length: int) -> int:
    """The shortest prefix of the distinct ``places`` with at least ``wanted`` distinct values; all bits if none has.

    One job counts all prefixes: neighbours in order differ first at some bit, and are apart for every prefix that has it.
    Neighbours are found within the bins of ``_numbered_cells``; the bins themselves are few.
    """
    shift = max(0, length - BIN_BITS)
    binned = places.withColumn("_bin", F.shiftright("place", shift))
    before = F.lag("place").over(W.partitionBy("_bin").orderBy("place"))
    apart = F.when(before.isNotNull(), F.lit(length) - F.length(F.bin(F.col("place").bitwiseXOR(before))))
    rows = binned.withColumn("_first", apart).groupBy(F.when(F.col("_first").isNull(), F.col("_bin")).alias("bin"), F.col("_first").alias("first")).agg(F.count(F.lit(1)).alias("n")).collect()
    bins = [r.bin for r in rows if r.first is None]  # at most 2 ** BIN_BITS; the other rows are at most ``length``
    for some in range(length):
        if some <= length - shift:
            distinct = len({b >> (length - shift - some) for b in bins})
        else:
            distinct = len(bins) + sum(r.n for r in rows if r.first is not None and r.first < some)
        if distinct >= wanted:
            return some
    return length


def _rounds(sizes: DataFrame, wanted: int) -> tuple[int, int, int]:
    """For cells of ``n`` records each, fewer than all of which are wanted: the whole rounds that fit in ``wanted`` when
    every cell gives one record a round as long as it has any, the records left for the last round, and the cells in it.

    The distinct sizes are at most the root of twice the records, and one small task runs over them.
    """
    kinds = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    kinds = kinds.unionByName(kinds.sparkSession.createDataFrame([(0, 0)], "n bigint, c bigint"))
    upto = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    after = W.orderBy("n").rowsBetween(1, W.unboundedFollowing)
    larger = F.coalesce(F.sum("c").over(after), F.lit(0))
    given = kinds.select("n", larger.alias("larger"), (F.sum(F.col("n") * F.col("c")).over(upto) + F.col("n") * larger).alias("given"))
    at = given.filter(F.col("given") < wanted).orderBy(F.col("n").desc()).first()
    more = -(-(wanted - at.given) // at.larger) - 1
    return at.n + more, wanted - at.given - more * at.larger, at.larger


def _numbered_cells(cells: DataFrame, cell: str, length: int) -> DataFrame:
    """Adds rank, the 0-based place of each distinct cell in the global order: cells are numbered within bins of the curve
    and the bins are totalled. A bin is a stretch of the curve, so it has at most 2 ** (length - BIN_BITS) cells."""
    binned = cells.withColumn("_bin", F.shiftright(cell, max(0, length - BIN_BITS)))
    totals = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_bin", before.alias("_before"))  # at most 2 ** BIN_BITS rows
    inner = F.row_number().over(W.partitionBy("_bin").orderBy(cell)) - 1
    return binned.withColumn("_inner", inner).join(F.broadcast(totals), "_bin").withColumn("rank", F.col("_before") + F.col("_inner")).drop("_bin", "_before", "_inner")


def _evenly(rank: Column, chosen: int, of: int) -> Column:
    """Whether the systematic choice of ``chosen`` of ``of`` numbered things has this one."""
    at = lambda r: F.floor(r.cast("decimal(20,0)") * F.lit(chosen) / F.lit(of))
    return at(rank + 1) > at(rank)


def varied_subset(cells: DataFrame, wanted: int, length: int = FEATURES * BITS) -> DataFrame:
    """(id, cell): ``wanted`` records of (id, penalty, place), or all if there are not more.

    Within a cell the smallest penalty, then the smallest id, is the best; repeated ids count once.
    """
    cells = materialize(cells.groupBy("id").agg(F.min("penalty").alias("penalty"), F.min("place").alias("place")), "cells")
    if wanted <= 0 or cells.count() <= wanted:
        return cells.filter(F.lit(wanted > 0)).select("id", F.col("place").alias("cell"))
    places = materialize(cells.select("place").distinct(), "places")
    prefix = _prefix_length(places, wanted, length)
    celled = cells.withColumn("cell", F.shiftright("place", length - prefix))
    sizes = materialize(celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    full, left, here = _rounds(sizes, wanted)
    last = _numbered_cells(sizes.filter(F.col("n") > full), "cell", prefix).filter(_evenly(F.col("rank"), left, here)).select("cell", F.lit(1).alias("more"))
    # A cell gives full records, and one more if the last round chose it; only that many of each are ranked. The rank limit
    # is applied before the shuffle as well, so a cell with a third of all records sends few.
    best = W.partitionBy("cell").orderBy("penalty", "id")
    top = celled.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= full + 1)
    return top.join(last, "cell", "left").filter(F.col("_r") <= full + F.coalesce("more", F.lit(0))).select("id", "cell")


def clip_penalty(df: DataFrame) -> Column:
    """Missing or contradictory fields of a clip."""
    missing = [df[c].isNull().cast("int") for c in ("fps", "resolution", "dataset_name", "num_frames")]
    odd = F.coalesce((df["num_frames"] != F.get(df["cut"], F.lit(1)) - F.get(df["cut"], F.lit(0))).cast("int"), F.lit(1))
    return missing[0] + missing[1] + missing[2] + missing[3] + odd


def p3_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the clips of toy_filter, by the variety of their captions."""
    clips = table(spark, sf_dir, "toy_filter")
    features = materialize(word_features(clips, "clip_id", "cap", clip_penalty(clips)), "features")
    return varied_subset(curve_cells(features), clips.select("clip_id").distinct().count() // 20).select(F.col("id").alias("clip_id"), "cell")
