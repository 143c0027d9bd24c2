"""The stateful operators on streams. Each has a batch twin that gives the same rows on the same input."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cliploom.operators.state import composed
from cliploom.operators.windows import HISTORY, TARGET


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_windows(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, events, total): tumbling windows; rows later than ``late`` may fall out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "total")


DRIFT = "key string, place bigint, drift boolean"


def drift_flags(chunks: DataFrame, rho: float = 0.9, delta: float = 0.15) -> DataFrame:
    """Drift flags of (key, place, mean, variance). State of a key: its moving averages. Within a batch rows are taken in
    order of place; batches must come in that order."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, variance = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("place")
        x = rows[["mean", "variance"]].to_numpy()
        begun = np.array([mean, variance] if mean is not None else x[0])
        weight, folded = composed(np.full(len(x), rho), x * (1 - rho), np.r_[True, np.zeros(len(x) - 1, bool)])
        after = folded + weight[:, None] * begun
        before = np.vstack([begun, after[:-1]])
        far = (np.abs(x - before) > delta).all(axis=1)
        state.update((float(after[-1, 0]), float(after[-1, 1])))
        yield pd.DataFrame({"key": key[0], "place": rows["place"].to_numpy(), "drift": far})

    return chunks.groupBy("key").applyInPandasWithState(step, DRIFT, "mean double, variance double", "append", GroupStateTimeout.NoTimeout)


def newest_buffer(rows: DataFrame, size: int) -> DataFrame:
    """(key, ids): the last ``size`` ids of each key so far, after each batch; rows are (key, place, ident)."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames)).sort_values("place")["ident"].tolist()
        held = ((list(state.get[0]) if state.exists else []) + new)[-size:]
        state.update((held,))
        yield pd.DataFrame({"key": [key[0]], "ids": [held]})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, ids array<bigint>", "ids array<bigint>", "update", GroupStateTimeout.NoTimeout)


def history_target(rows: DataFrame, history: int = HISTORY, target: int = TARGET) -> DataFrame:
    """(key, chunk, history, target) of (key, place, value) as a stream, as the batch operator gives them: a chunk comes out
    once it is full. State of a key: the values before its open chunk, at most ``history``, those of the chunk, and its number.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, begun, chunk = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        values = begun + pd.concat(list(frames)).sort_values("place")["value"].tolist()
        full = len(values) // target
        line = past + values
        out = []
        for c in range(full):
            at = len(past) + c * target
            before = line[max(0, at - history) : at]
            out.append((key[0], chunk + c, [0.0] * (history - len(before)) + before, line[at : at + target]))
        end = len(past) + full * target
        state.update((line[max(0, end - history) : end], line[end:], chunk + full))
        yield pd.DataFrame(out, columns=["key", "chunk", "history", "target"])

    kind = "key string, chunk bigint, history array<double>, target array<double>"
    return rows.groupBy("key").applyInPandasWithState(step, kind, "past array<double>, open array<double>, chunk bigint", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what there is and returns what it wrote to ``path``, beside which its checkpoint lies; a later
    run with the same path goes on where this one stopped. In complete mode the last state replaces the one before."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class Progress(StreamingQueryListener):
    """Keeps the numbers of the last ``size`` batches of all streams: (name, batch, rows in, rows a second). Add it with
    ``spark.streams.addListener``."""

    def __init__(self, size: int = 1000):
        self.batches: deque[tuple[str | None, int, int, float]] = deque(maxlen=size)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
