"""Connected components of an edge table, by contraction.

Each round every vertex moves to one vertex among itself and its neighbours, the smallest id in even rounds (stars fall
together at once) and the smallest hash in odd ones (chains shrink by a part of their length). Edges are rewritten and
what is left is again a graph with the same components. Once no more than ``SMALL_GRAPH`` edges are left, a bound that
does not grow with the data, one task finishes them with union-find.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.session import materialize

SMALL_GRAPH = 200_000


def _union_find(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(frames)
    if not parts:
        return
    edges = pd.concat(parts)
    ids, flat = np.unique(edges[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in flat.reshape(-1, 2):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    yield pd.DataFrame({"uid": ids, "comp": ids[[find(x) for x in range(len(ids))]]})


def components(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(uid, comp) for every vertex of ``edges`` (a, b); comp is one of the vertices. Loops and repeated edges are
    allowed, edges with a null end are ignored, an empty table gives an empty result."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    e = materialize(e, "edges")
    labels, turn = None, 0
    while (left := e.count()) > small:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(c, F.lit(t)))
        best = both.groupBy("a").agg(F.min_by("b", order("b")).alias("m"))
        move = materialize(best.select(F.col("a").alias("uid"), F.when(order("a") < order("m"), F.col("a")).otherwise(F.col("m")).alias("comp")), "moves")
        to = lambda side: move.select(F.col("uid").alias(side), F.col("comp").alias("_" + side))
        moved = e.join(to("a"), "a").join(to("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        e = materialize(moved.filter("a <> b").distinct(), "edges")
        labels = move if labels is None else _follow(labels, move)
        turn += 1
    if left:
        last = materialize(e.coalesce(1).mapInPandas(_union_find, "uid bigint, comp bigint"), "moves")
        labels = last if labels is None else _follow(labels, last)
    if labels is None:
        return e.select(F.col("a").alias("uid"), F.col("b").alias("comp"))
    return materialize(labels, "components") if turn else labels


def _follow(labels: DataFrame, move: DataFrame) -> DataFrame:
    step = move.select(F.col("uid").alias("comp"), F.col("comp").alias("_to"))
    return labels.join(step, "comp", "left").select("uid", F.coalesce("_to", "comp").alias("comp"))
