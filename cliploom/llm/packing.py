"""Problem 7: documents of varying length in containers of a fixed capacity, with little unused space.

Method: configuration linear program over the length histogram. A configuration says how many items of each length one
container takes. Multiplicative weights solve the program: every length has a price, which falls by a factor with each part
of its items that is covered, so lengths that lag behind become dear; the best configuration at these prices is found by
dynamic programming over the capacity (a knapsack). It is used as often as its scarcest length allows, rounded down to
whole containers; what rounding leaves uncovered is priced again, so all items are placed by the program. A lower bound
from dual prices tells how far the result is from the best one; beyond ``GAP`` the program is solved again with prices
that fall at another rate. Lengths, turns and configurations are bounded by the capacity, not by the number of documents;
documents then take the places of their length in turn.

Only texts above the capacity are split, into pieces of the capacity and a rest.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.encode import ByteBPE
from cliploom.llm.mixing import hash_digits, running
from cliploom.session import materialize, spread, table

#: Steps that a capacity is divided into; lengths are rounded up to a step, so an item wastes less than a step.
STEPS = 2048
#: How much dearer a length is that fills the whole room, for its size, than a very short one: long items fit least well
#: into what is left in the end.
LONG = 0.2
#: Rates at which a length's price falls with its coverage, tried in turn until the gap to the bound is small enough.
FALLS = (0.3, 1.0, 0.1)
GAP = 0.001
#: Lengths priced in one turn: those covered least, and others from short to long.
LAGGING, OTHERS = 48, 32


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """The vocabulary file of a public tokenizer, a rank file if there is one."""
    if folder is None:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.__file__)
    for ending in (".tiktoken", ".json", ".model"):
        if os.path.exists(path := os.path.join(folder, name + ending)):
            return path
    raise ValueError(f"no vocabulary file of tokenizer {name!r} in {folder}")


_COUNTERS: dict[str, object] = {}


def _counter(path: str):
    if path not in _COUNTERS:
        if path.endswith(".tiktoken"):
            bpe = ByteBPE.load(path)
            _COUNTERS[path] = lambda texts: [len(bpe.packed(t)) // 4 if t else 0 for t in texts]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _COUNTERS[path] = lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = lambda texts: [len(i) for i in sp.encode([x or "" for x in texts], num_threads=1)]
    return _COUNTERS[path]


def text_sizes(df: DataFrame, tokenizers: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tokenizer, tokens) of each document by each tokenizer; null and empty texts have 0 tokens, null ids fall out."""
    paths = {name: tokenizer_file(name) for name in tokenizers}
    source = spread(df.select(df[id_col].cast("bigint").alias("doc"), df[text_col].alias("_text")).filter("doc is not null"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t if isinstance(t, str) else None for t in f["_text"]]
            for name, path in paths.items():
                yield pd.DataFrame({"doc": f["doc"], "tokenizer": name, "tokens": _counter(path)(texts)})

    return source.mapInPandas(run, "doc bigint, tokenizer string, tokens bigint")


def best_configuration(lengths: np.ndarray, prices: np.ndarray, limits: np.ndarray, room: int) -> np.ndarray:
    """How often each length occurs in the most valuable filling of ``room``, at most ``limits`` times, by dynamic
    programming over the room. A length's copies are taken in lots of 1, 2, 4, ..., which reach every number up to its limit.
    """
    best, lots = np.zeros(room + 1), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        copies, lot = min(int(limits[i]), room // int(lengths[i])), 1
        while copies > 0:
            n = min(lot, copies)
            width = n * int(lengths[i])
            with_lot = best[: room + 1 - width] + n * prices[i]
            lots.append((i, n, width, with_lot > best[width:]))
            np.maximum(best[width:], with_lot, out=best[width:])
            copies, lot = copies - n, lot * 2
    config, free = np.zeros(len(lengths), dtype=np.int64), room
    for i, n, width, taken in reversed(lots):
        if free >= width and taken[free - width]:
            config[i] += n
            free -= width
    return config


def solve(counts: np.ndarray, fall: float) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many containers each is used for; together they hold exactly ``counts`` items of the lengths
    1, 2, .... Full-size items are alone."""
    room = len(counts)
    uses, left = [], counts.copy()
    if left[-1]:
        alone = np.zeros(room, dtype=np.int64)
        alone[-1] = 1
        uses.append((alone, int(left[-1])))
        left[-1] = 0
    size = np.arange(1, room + 1) / room
    while len(there := np.flatnonzero(left)):
        covered = 1 - left[there] / counts[there]
        order = np.lexsort((-there, covered))
        rest = np.sort(there[order[LAGGING:]])
        spread = np.linspace(0, 1, min(OTHERS, len(rest))) ** 2 * (len(rest) - 1)
        priced = np.r_[there[order[:LAGGING]], rest[np.unique(spread.astype(int))]]
        covered = 1 - left[priced] / counts[priced]
        prices = size[priced] * (1 + LONG * size[priced]) * np.exp(-fall * (covered - covered.min()))
        part = best_configuration(priced + 1, prices, left[priced], room)
        used = part > 0
        times = int((left[priced[used]] // part[used]).min())
        config = np.zeros(room, dtype=np.int64)
        config[priced] = part
        left -= times * config
        uses.append((config, times))
    return uses


def least_containers(counts: np.ndarray) -> int:
    """No packing has fewer containers: the greatest value of the items at prices that no filling of a container exceeds 1
    of. For each limit k up to half the room such prices are 0 below k, 1 above room - k and the part of the room between."""
    room = len(counts)
    size = np.arange(1, room + 1)
    items, volume = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * size)]
    k = np.arange(1, room // 2 + 1)
    above = items[-1] - items[room - k]
    between = volume[room - k] - volume[k - 1]
    return int(max([-(-volume[-1] // room), *(above + -(-between // room))]))


@dataclass(frozen=True)
class Plan:
    """Places for items. Item number r (from 0) of length l is in segment s with first[s] <= r, in container
    start[s] + (r - first[s]) % containers[s]."""

    capacity: int
    step: int
    containers: int
    bound: int
    segments: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def place(self, length: int, numbers: np.ndarray) -> np.ndarray:
        first, start, many = self.segments[length]
        s = np.searchsorted(first, numbers, side="right") - 1
        return start[s] + (numbers - first[s]) % many[s]


def step_of(capacity: int, steps: int = STEPS) -> int:
    return max(1, -(-capacity // steps))


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """A plan for the items that the histogram counts by length in steps of the capacity; its containers are within ``GAP``
    of ``bound``, or it is the best of all rates of ``FALLS``."""
    step = step_of(capacity)
    room = capacity // step
    counts = np.zeros(room, dtype=np.int64)
    for length, n in histogram.items():
        counts[length - 1] += n
    bound, chosen, fewest = least_containers(counts), [], None
    for fall in FALLS:
        uses = solve(counts, fall)
        many = sum(times for _, times in uses)
        if fewest is None or many < fewest:
            fewest, chosen = many, uses
        if fewest <= bound * (1 + GAP):
            break
    segments: dict[int, list[list[int]]] = {}
    begun, at = np.zeros(room, dtype=np.int64), 0
    for config, times in chosen:
        for length in (np.flatnonzero(config) + 1).tolist():
            segments.setdefault(length, []).append([int(begun[length - 1]), at, times])
            begun[length - 1] += times * config[length - 1]
        at += times
    return Plan(capacity, step, at, bound, {l: tuple(np.array(rows, dtype=np.int64).T) for l, rows in segments.items()})


def plans_of(histogram: DataFrame, capacities: dict[int, int]) -> dict[int, Plan]:
    """The plan of each target of (target_id, length, n), one task a target; a histogram has at most STEPS rows a target and
    a plan as many segments as its turns and lengths allow, whatever the number of documents."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for target, rows in pd.concat([pd.DataFrame({"target_id": [], "length": [], "n": []}), *frames]).groupby("target_id"):
            plan = make_plan(dict(zip(rows["length"].astype(int), rows["n"].astype(int))), capacities[int(target)])
            yield pd.DataFrame({"target_id": [int(target)], "plan": [pickle.dumps(plan)]})

    numbers = F.create_map(*(F.lit(x) for number, i in enumerate(capacities) for x in (i, number))) if capacities else F.create_map().cast("map<bigint,int>")
    spread = histogram.repartitionById(max(1, len(capacities)), numbers[F.col("target_id")])
    found = {r.target_id: pickle.loads(r.plan) for r in spread.mapInPandas(run, "target_id bigint, plan binary").collect()}
    return {i: found.get(i) or make_plan({}, c) for i, c in capacities.items()}


ITEMS = "target_id bigint, doc bigint, piece int, tokens bigint, length int"


def pack(sizes: DataFrame, targets: list[tuple[int, int, str]]) -> DataFrame:
    """(target_id, container_id, doc, piece, tokens) for targets (id, capacity, tokenizer) and ``text_sizes``.

    Containers are numbered from 0 for each target. A document without tokens takes no room: its container is null.
    Targets without a capacity above 0 have no rows.
    """
    spark = sizes.sparkSession
    targets = [t for t in targets if t[0] is not None and t[1] is not None and t[1] > 0]
    # A step must divide the room for a full piece evenly; the plan's steps follow from the capacity alone.
    spec = spark.createDataFrame([(i, c, k, step_of(c)) for i, c, k in targets], "target_id bigint, capacity bigint, tokenizer string, step bigint")
    items = sizes.join(F.broadcast(spec), "tokenizer")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    items = items.withColumn("_all", F.col("tokens")).withColumn("piece", F.explode(F.sequence(F.lit(1), pieces)))
    items = items.withColumn("tokens", F.least(F.col("capacity"), F.col("_all") - (F.col("piece") - 1) * F.col("capacity")))
    # The last step may be short; only full pieces reach into it, and they are alone.
    room = F.floor(F.col("capacity") / F.col("step"))
    length = F.least(room, F.ceil(F.col("tokens") / F.col("step"))).cast("int")
    items = materialize(items.select("target_id", "doc", "piece", "tokens", length.alias("length")), "items")
    histogram = items.filter("length > 0").groupBy("target_id", "length").agg(F.count(F.lit(1)).alias("n"))
    plans = plans_of(histogram, {i: c for i, c, _ in targets})

    digits = hash_digits(max(1, items.count() // max(1, len(targets))))
    keyed = items.filter("length > 0").withColumn("_bin", F.substring(F.md5(F.concat_ws(":", "doc", "piece")), 1, digits)).withColumn("_one", F.lit(1))
    numbered = running(keyed, ["target_id", "length"], "_bin", ["doc", "piece"], "_one", "_number").select("target_id", "doc", "piece", "tokens", "length", "_number")

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            key = f["target_id"].to_numpy() * (STEPS + 1) + f["length"].to_numpy()
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            where = np.zeros(len(f), dtype=np.int64)
            numbers = f["_number"].to_numpy() - 1
            for a, b in zip(cuts, [*cuts[1:], len(f)]):
                rows = order[a:b]
                where[rows] = plans[int(f["target_id"].iloc[rows[0]])].place(int(f["length"].iloc[rows[0]]), numbers[rows])
            yield pd.DataFrame({"target_id": f["target_id"], "container_id": where, "doc": f["doc"], "piece": f["piece"], "tokens": f["tokens"]})

    placed = numbered.mapInPandas(place, "target_id bigint, container_id bigint, doc bigint, piece int, tokens bigint")
    empty = items.filter("length <= 0").select("target_id", F.lit(None).cast("bigint").alias("container_id"), "doc", "piece", "tokens")
    return placed.unionByName(empty)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    targets = [(r.target_id, r.capacity, r.tokenizer) for r in table(spark, sf_dir, "pack_target").select("target_id", "capacity", "tokenizer").collect()]  # a fixed table
    sizes = materialize(text_sizes(table(spark, sf_dir, "documents"), sorted({t[2] for t in targets if t[2]})), "sizes")
    return pack(sizes, targets), targets


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document or piece of a document, for every pack_target."""
    packed, _ = _packed(spark, sf_dir)
    return packed.select("target_id", "container_id", F.col("doc").alias("doc_id"), F.col("piece").alias("piece_no"), "tokens")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pack_target: containers, tokens, the fewest containers that could hold them, and the share of room used."""
    packed, targets = _packed(spark, sf_dir)
    spec = spark.createDataFrame(targets, "target_id bigint, capacity bigint, tokenizer string")
    sums = packed.filter("container_id is not null").groupBy("target_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    out = sums.join(F.broadcast(spec), "target_id")
    return out.select("target_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("at_least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pack_target what must hold of its packing: all documents are there, and none of these occurs: a container above
    the capacity, a document of several pieces that would have fitted whole, one in fewer or more pieces than needed."""
    packed, targets = _packed(spark, sf_dir)
    spec = F.broadcast(spark.createDataFrame(targets, "target_id bigint, capacity bigint, tokenizer string").drop("tokenizer"))
    loads = packed.filter("container_id is not null").groupBy("target_id", "container_id").agg(F.sum("tokens").alias("load")).join(spec, "target_id")
    loads = loads.groupBy("target_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("above_capacity"))
    docs = packed.groupBy("target_id", "doc").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces")).join(spec, "target_id")
    split = (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))
    docs = docs.groupBy("target_id", "capacity").agg(F.count(F.lit(1)).alias("documents"), F.count_if(split).alias("needless_splits"), F.count_if(F.col("pieces") != needed).alias("wrong_pieces"))
    return docs.join(loads, "target_id", "left").select("target_id", "capacity", "documents", F.coalesce("above_capacity", F.lit(0)).alias("above_capacity"), "needless_splits", "wrong_pieces")


SQL = {
    "p7_checks": """SELECT target_id, CAST(capacity AS BIGINT) AS capacity, count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS above_capacity,
  CAST(0 AS BIGINT) AS needless_splits, CAST(0 AS BIGINT) AS wrong_pieces FROM pack_target, documents WHERE doc_id IS NOT NULL AND capacity > 0 GROUP BY 1, 2""",
}
