"""Candidate pairs of similar texts: signatures, bands, buckets, sketches and the exact check. Used by problems 4 and 5.

Texts are a table (uid, key); uids of one stored file are consecutive. A batch of texts sends each band one row with the
32-bit hash of every text in it, so a text costs four bytes a band and its uid follows from its place. One task of a band
(or of a part of its hashes, once a band exceeds ``PART_TEXTS`` texts) sorts the hashes and finds the buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.shingles import RUN, Plan, band_hashes, jaccard, sets_of, signatures, sketches

#: Texts of a band that one task sorts; beyond, the band is split by its upper hash bits.
PART_TEXTS = 8_000_000
#: Texts of a batch with one hash beyond which these go to groups of their own, once a band is split.
HOT_IN_BATCH = 64
#: Texts whose signatures are held at once.
SIGNED_TEXTS = 5_000
#: Pairs whose texts' runs are held at once in the exact check.
CHECKED_PAIRS = 500
#: Pairs of a bucket beyond which its members are compared by sketches in pieces of PIECE, without making its pairs.
LARGE_BUCKET = 1 << 12
PIECE = 512
#: Deviations below the expected agreement at the threshold up to which a pair still goes to the exact check.
SKETCH_SIGMAS = 4.5
SKETCH_SIZE = 256


def numbered(texts: DataFrame) -> DataFrame:
    """Adds uid: unique, and consecutive within a partition as it is written."""
    return texts.withColumn("uid", F.monotonically_increasing_id())


def band_parts(total: int) -> int:
    parts = 1
    while total / parts > PART_TEXTS:
        parts *= 2
    return parts


def band_rows(texts: DataFrame, plan: Plan, total: int, run: int = RUN, side: int = 0, split_hot: bool = False) -> DataFrame:
    """(band, part, side, base, n, hashes, at): per batch of texts and band, the band's hash of each text.

    ``at`` is null where the texts are the consecutive uids from ``base`` on; otherwise it holds 32-bit distances from it.
    split_hot, for stars: where one hash has many texts of a batch, these go to one of as many further parts as there are,
    and only the first of them to the hash's own part as well. So no part gathers all texts of a hash, and as a part's
    centre is the first text of some batch, all stars of the hash hang together.
    """
    parts = band_parts(total)

    def emit(uids: np.ndarray, keys: list[str]) -> Iterator[pa.RecordBatch]:
        signature, _ = signatures(keys, plan.bins, run)
        hashes = band_hashes(signature, plan)
        rows: list[tuple] = []
        for band in range(plan.bands):
            if parts == 1:
                rows.append((band, 0, side, int(uids[0]), len(uids), hashes[band].tobytes(), None))
                continue
            part = (hashes[band] >> np.uint32(33 - parts.bit_length())).astype(np.int64)
            at = np.arange(len(uids))
            if split_hot:
                _, first, of, count = np.unique(hashes[band], return_index=True, return_inverse=True, return_counts=True)
                hot = count[of] > HOT_IN_BATCH
                own = ~hot
                own[first] = True
                aside = np.flatnonzero(hot)
                at = np.r_[at[own], aside]
                part = np.r_[part[own], np.full(len(aside), parts + int(uids[0]) // SIGNED_TEXTS % parts)]
            for p in np.unique(part):
                here = at[part == p]
                rows.append((band, int(p), side, int(uids[0]), len(here), hashes[band][here].tobytes(), (uids[here] - uids[0]).astype(np.uint32).tobytes()))
        names = ["band", "part", "side", "base", "n", "hashes", "at"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            uids, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            breaks = np.flatnonzero(np.diff(uids) != 1) + 1
            for a, b in zip([0, *breaks], [*breaks, len(uids)]):
                for c in range(a, b, SIGNED_TEXTS):
                    yield from emit(uids[c : min(b, c + SIGNED_TEXTS)], keys[c : min(b, c + SIGNED_TEXTS)])

    schema = "band int, part int, side int, base bigint, n bigint, hashes binary, at binary"
    return texts.select("uid", "key").mapInArrow(run_batches, schema)


def _bucket_arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes that occur at least twice, sorted, with uid and side of each. Uids are worked out for these only."""
    base, sizes, sides = (rows.column(c).to_numpy() for c in ("base", "n", "side"))
    blobs = rows.column("hashes").to_pylist()
    h = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs])
    del blobs
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    keep = np.zeros(len(h), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order, h = order[keep], h[keep]
    starts = np.cumsum(sizes) - sizes
    row = np.searchsorted(starts, order, side="right") - 1
    offset = order - starts[row]
    uids = base[row] + offset
    for i, at in enumerate(rows.column("at").to_pylist()):
        if at is not None:
            here = row == i
            uids[here] = base[i] + np.frombuffer(at, np.uint32)[offset[here]]
    tidy = np.lexsort((uids, h))
    return h[tidy], uids[tidy], sides[row][tidy]


STARS = "a bigint, b bigint, bucket bigint"


def star_pairs(bands: DataFrame, split: bool = False) -> DataFrame:
    """(a, b, bucket): in every bucket the smallest uid with each other member; m members give m - 1 pairs. bucket names
    buckets of more than two, whose members may still have to meet each other, and is null for the others; where a band is
    split, no part knows the size of a whole bucket, and all are named."""

    def stars(key: tuple, rows: pa.Table) -> pa.Table:
        h, u, _ = _bucket_arrays(rows)
        if not len(h):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64())})
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        centre, size_of = np.repeat(u[first], size), np.repeat(size, size)
        member = np.ones(len(h), bool)
        member[first] = False
        name = (key[0].as_py() << 32) | h.astype(np.int64)
        bucket = pa.array(name[member], mask=(size_of[member] == 2) & (not split))
        return pa.table({"a": centre[member], "b": u[member], "bucket": bucket})

    return bands.groupBy("band", "part").applyInArrow(stars, STARS)


CROSS = "a bigint, b bigint, bucket bigint, piece int, others int"


def cross_pairs(bands: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(a, b, bucket, piece, others): members of side 0 with members of side 1 of the same bucket, in tables of at most
    ``block`` rows; pairs within a side never arise. Each wanted pair must come out by itself here, so stars would not do.

    A bucket of more than ``LARGE_BUCKET`` pairs gives its members instead, each as a row with a null other side, its piece
    of ``PIECE`` members and the number of the other side's pieces; ``large_bucket_pairs`` compares them.
    """

    def cross(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, u, s = _bucket_arrays(pa.Table.from_batches(batches))
        if not len(h):
            return
        new = np.r_[True, h[1:] != h[:-1]]
        group, name = np.cumsum(new) - 1, (key[0].as_py() << 32) | h[new].astype(np.int64)
        sides = []
        for side in (0, 1):
            members, of = u[s == side], group[s == side]
            n = np.bincount(of, minlength=len(name))
            sides.append((members, of, n, np.cumsum(n) - n))
        (a_all, g_all, n_left, _), (u_right, _, n_right, starts) = sides
        large = n_left * n_right > LARGE_BUCKET
        small = (n_right[g_all] > 0) & ~large[g_all]
        a_all, g_all = a_all[small], g_all[small]
        many = n_right[g_all]
        ends = np.cumsum(many)
        for at in range(0, int(ends[-1]) if len(ends) else 0, block):
            place = np.arange(at, min(at + block, int(ends[-1])))
            row = np.searchsorted(ends, place, side="right")
            b = u_right[starts[g_all[row]] + place - (ends[row] - many[row])]
            yield _cross_batch(len(place), a=a_all[row], b=b)
        for side, (members, of, _, first) in enumerate(sides):
            other = -(-sides[1 - side][2] // PIECE)
            here = np.flatnonzero(large[of])
            for at in range(0, len(here), block):
                i = here[at : at + block]
                yield _cross_batch(len(i), **{"ab"[side]: members[i]}, bucket=name[of[i]], piece=(i - first[of[i]]) // PIECE, others=other[of[i]])

    return bands.groupBy("band", "part").applyInArrow(cross, CROSS)


def _cross_batch(n: int, **columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"a": pa.int64(), "b": pa.int64(), "bucket": pa.int64(), "piece": pa.int32(), "others": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def large_bucket_pairs(crossed: DataFrame, left: DataFrame, right: DataFrame, threshold: float, screen: bool = True) -> DataFrame:
    """Likely pairs (a, b) of the large buckets of ``cross_pairs``; repeated where they share several.

    Every piece of a side meets every piece of the other, so a bucket is spread over many tasks; the sketches decide inside
    the join and only likely pairs leave it.
    """

    def side(members: DataFrame, uid: str, sketch: DataFrame, name: int) -> DataFrame:
        held = members.select(F.col(uid).alias("uid"), "bucket", "piece", "others").join(sketch, "uid")
        held = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        pieces = ("piece", "_other") if name == 0 else ("_other", "piece")
        return held.withColumn("place", F.struct("bucket", F.col(pieces[0]).alias("l"), F.col(pieces[1]).alias("r"))).withColumn("side", F.lit(name))

    members = crossed.filter("bucket is not null")
    l, r = side(members.filter("a is not null"), "a", left, 0), side(members.filter("b is not null"), "b", right, 1)
    return sketched_pairs(l, r, threshold, "place", "side", screen)


def sketch_rows(texts: DataFrame, run: int = RUN) -> DataFrame:
    """(uid, filled, s0..s3): 256 bits of each text."""

    def run_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, filled = sketches(batch.column(1).to_pylist(), run)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(filled, pa.int64()), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(4))], names=["uid", "filled", "s0", "s1", "s2", "s3"])

    return texts.select("uid", "key").mapInArrow(run_batches, "uid bigint, filled bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def _differing_bits(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(4)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _least_agreement(threshold: float) -> Column:
    """Bits that must agree: what pairs at the threshold show on average, less ``SKETCH_SIGMAS`` deviations. A deviation
    counts with the bins the poorer text filled, so short texts get a wider margin."""
    expected = (1 + threshold) / 2
    bins = F.greatest(F.lit(1.0), 0.8 * F.least("a_f", "b_f"))
    return SKETCH_SIZE * (expected - SKETCH_SIGMAS * F.sqrt(F.lit(expected * (1 - expected)) / bins))


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select(F.col("uid").alias(name), F.col("filled").alias(f"{name}_f"), *(F.col(f"s{i}").alias(f"{name}{i}") for i in range(4)), *more)


def likely(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, screen: bool = True) -> DataFrame:
    """Pairs (a, b) whose sketches agree enough, or all without ``screen``; adds ``agree``, the number of equal bits."""
    both = pairs.join(_side(left, "a"), "a").join(_side(right, "b"), "b")
    both = both.withColumn("agree", F.lit(SKETCH_SIZE) - _differing_bits("a", "b"))
    return (both.filter(F.col("agree") >= _least_agreement(threshold)) if screen else both).select("a", "b", "agree")


def in_pieces(left: DataFrame, right: DataFrame, same: str, members: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``place`` for ``same``, of which ``members`` tells how many rows have it: where these are more than
    PIECE, the rows of each side fall into pieces by a hash of uid and every piece meets every piece of the other side, so no
    task joins a hot value by itself."""
    pieces = F.ceil(F.col(members) / PIECE).cast("int")
    own, other = F.pmod(F.xxhash64("uid"), pieces).cast("int"), F.explode(F.sequence(F.lit(0), pieces - 1))
    out = []
    for rows, names in ((left, ("_own", "_other")), (right, ("_other", "_own"))):
        held = rows.withColumn("_own", own).withColumn("_other", other)
        out.append(held.withColumn("place", F.struct(F.col(same), F.col(names[0]).alias("l"), F.col(names[1]).alias("r"))).drop("_own", "_other"))
    return out[0], out[1]


def sketched_pairs(left: DataFrame, right: DataFrame, threshold: float, same: str, other: str, screen: bool = True) -> DataFrame:
    """Pairs (a, b) of sketched rows with the same ``same``, different ``other`` and, with ``screen``, sketches that agree
    enough."""
    l, r = _side(left, "a", same, F.col(other).alias("_l")), _side(right, "b", same, F.col(other).alias("_r"))
    enough = (F.lit(SKETCH_SIZE) - _differing_bits("a", "b")) >= _least_agreement(threshold)
    return l.join(r, same).filter((F.col("_l") != F.col("_r")) & (enough if screen else F.lit(True))).select("a", "b")


def confirmed(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, run: int = RUN) -> DataFrame:
    """Pairs (a, b) whose sets of runs are at least ``threshold`` similar, compared exactly."""
    both = pairs.select("a", "b").join(left.select(F.col("uid").alias("a"), F.col("key").alias("ka")), "a")
    return checked(both.join(right.select(F.col("uid").alias("b"), F.col("key").alias("kb")), "b"), threshold, run)


def checked(both: DataFrame, threshold: float, run: int = RUN) -> DataFrame:
    """Pairs (a, b) of (a, b, ka, kb) whose texts ka and kb are similar enough."""
    return both.select("a", "b", "ka", "kb").mapInArrow(exact_check(threshold, run), "a bigint, b bigint")


def exact_check(threshold: float, run: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHECKED_PAIRS):
                batch = whole.slice(at, CHECKED_PAIRS)
                texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                distinct = list(dict.fromkeys(texts[0] + texts[1]))
                sets = dict(zip(distinct, sets_of(distinct, run)))
                ok = pa.array([jaccard(sets[x], sets[y]) >= threshold for x, y in zip(*texts)], pa.bool_())
                yield batch.select([0, 1]).filter(ok)

    return check
