"""Runs of consecutive characters of many texts at once, their one-permutation signatures and exact similarities.

Everything works on whole batches held as flat arrays with offsets; nothing is done per text in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RUN = 10
#: Texts whose runs are hashed together; keeps the arrays within the processor's cache.
CHUNK_CHARS = 400_000
EMPTY = np.uint32(0xFFFFFFFF)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass(frozen=True)
class Plan:
    """Banding: ``bands`` bands of ``rows`` bins. A pair of similarity s meets in some band with 1 - (1 - s^rows)^bands."""

    rows: int
    bands: int

    @property
    def bins(self) -> int:
        return self.rows * self.bands


def plan_for(texts: int) -> Plan:
    """More rows per band as the collection grows, so that chance meetings per text stay few, and as many bands as keep
    the chance of missing a pair of similarity 0.5 or more no greater than that of the first plan."""
    if texts <= 2_000_000:
        return Plan(5, 128)
    if texts <= 40_000_000:
        return Plan(6, 259)
    return Plan(7, 519)


#: For callers to whom a missed pair costs more than time: misses a pair of similarity 0.5 once in two thousand million.
NEARLY_EXACT = Plan(3, 160)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD[3]
    x ^= x >> np.uint64(29)
    x *= _ODD[4]
    x ^= x >> np.uint64(32)
    return x


def run_hashes(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of all texts, one after another (repeats kept), and the number of runs of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(sizes - run + 1, 0)
    total = int(sizes.sum())
    if total < run:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("latin-1"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = {1: codes.astype(np.uint64) + np.uint64(1)}
    width = 1
    while width * 2 <= run:
        a = h[width]
        h[width * 2] = a[:-width] * _ODD[width.bit_length() % 3] + a[width:]
        width *= 2
    value, done = h[width], width
    for w in sorted(h, reverse=True):
        if run - done >= w:
            tail = h[w][done:]
            n = min(len(value), len(tail))
            value, done = value[:n] * _ODD[0] + tail[:n], done + w
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(total, dtype=bool)
    ends = starts + counts
    # positions of each text from its last run on do not begin a run of it
    gap = sizes - counts
    drop = np.repeat(ends - (np.cumsum(gap) - gap), gap) + np.arange(int(gap.sum()))
    keep[drop] = False
    return mix(value[keep[: len(value)]]), counts


_DONORS: dict[tuple[int, int], np.ndarray] = {}


def donor_bins(bins: int, attempt: int) -> np.ndarray:
    """For each bin, the bin whose value it takes at this attempt if it is empty; the same for all texts."""
    key = (bins, attempt)
    if key not in _DONORS:
        if len(_DONORS) > 4096:
            _DONORS.clear()
        _DONORS[key] = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
    return _DONORS[key]


def densify(block: np.ndarray) -> np.ndarray:
    """Optimal densification of the signatures in ``block``, in place; returns the number of bins filled before."""
    bins = block.shape[1]
    flat = block.reshape(-1)
    filled = flat != EMPTY
    counts = filled.reshape(block.shape).sum(axis=1)
    hole = np.flatnonzero(~filled)
    hole = hole[counts[hole // bins] > 0]
    attempt = 1
    while len(hole):
        col = hole % bins
        source = hole - col + donor_bins(bins, attempt)[col]
        ok = filled[source]
        flat[hole[ok]] = flat[source[ok]]
        hole = hole[~ok]
        attempt += 1
    return counts


def signatures(texts: list[str], bins: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation signatures (texts x bins, 32 bits) with optimal densification, and how many bins each text filled.

    Each run falls in one bin by its upper half and the bin keeps the smallest lower half. An empty bin takes the value of
    a bin that a hash of its own number and the attempt points to, the same for all texts, until that one was filled.
    Texts without a run keep empty bins and a count of 0.
    """
    n = len(texts)
    out = np.full((n, bins), EMPTY, dtype=np.uint32)
    filled = np.zeros(n, dtype=np.int64)
    sizes = np.cumsum([len(t) for t in texts])
    at = 0
    while at < n:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + CHUNK_CHARS, side="right")))
        hashes, counts = run_hashes(texts[at:to], run)
        if len(hashes):
            owner = np.repeat(np.arange(to - at, dtype=np.int64) * bins, counts)
            slot = owner + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            np.minimum(low, EMPTY - np.uint32(1), out=low)
            np.minimum.at(out[at:to].reshape(-1), slot, low)
            filled[at:to] = densify(out[at:to])
        at = to
    return out, filled


def band_hashes(signature: np.ndarray, plan: Plan) -> np.ndarray:
    """(bands x texts) 32-bit hashes of the bins of each band."""
    parts = signature.reshape(len(signature), plan.bands, plan.rows)
    h = np.zeros((len(signature), plan.bands), dtype=np.uint64)
    for r in range(plan.rows):
        h = (h ^ parts[:, :, r]) * _ODD[r % 5]
        h ^= h >> np.uint64(29)
    return np.ascontiguousarray((mix(h) >> np.uint64(32)).astype(np.uint32).T)


SKETCH_BINS = 256


def sketches(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """One bit of each of 256 bins as 4 signed longs a text, and how many bins were filled: enough to turn away pairs far
    below the threshold."""
    signature, filled = signatures(texts, SKETCH_BINS, run)
    bits = (mix(signature.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64), filled


def sets_of(texts: list[str], run: int = RUN) -> list[np.ndarray]:
    """The sorted distinct run hashes of each text."""
    hashes, counts = run_hashes(texts, run)
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c : e]) for e, c in zip(ends, counts)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sorted sets; 0 where both are empty."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)
