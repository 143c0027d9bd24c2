"""Problem 1: records that differ only in writing, collapsed with the number of their copies.

Method: incremental ledger. Every record has a canonical key. The ledger keeps, per bucket of keys, each key met so far
with its count and its earliest record. A new batch is aggregated by itself, full-outer-joined against the buckets it
touches, counts are added and the earlier record is kept. A ledger is a folder with one sub-folder per version, so a lost
executor or driver leaves the last complete version in place.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.text_keys import caption_key, caption_set, digest
from cliploom.session import fresh_path, materialize, spread, table

#: A ledger has at least this many buckets, and so many that about BUCKET_ROWS of the expected rows fall in each.
BUCKETS = 16
BUCKET_ROWS = 1_000_000
#: A key with more copies than a 1/HEAVY_PART of all rows is joined from a broadcast: there are at most HEAVY_PART such keys.
HEAVY_PART = 1000

#: What may stand around a record.
AROUND = " \t\r\n\f\v\u00a0\ufeff,"


# --- canonical keys -------------------------------------------------------------------------------------------------


def array_record_keys(df: DataFrame, tbl: str, id_col: str, entries_col: str) -> DataFrame:
    """Keys of rows by their set of captions. Rows without any caption of letters or digits, and null ids, have no key."""
    keys = caption_set(df[entries_col])
    rows = df.select(F.lit(tbl).alias("tbl"), df[id_col].cast("bigint").alias("id"), keys.alias("_k"))
    return rows.filter((F.size("_k") > 0) & F.col("id").isNotNull()).select("tbl", "id", digest(F.concat_ws(" ", "_k")).alias("key"))


def text_record_keys(df: DataFrame, tbl: str, id_col: str, text_col: str) -> DataFrame:
    """Keys of rows by one caption; blank and null captions and null ids have no key."""
    rows = df.select(F.lit(tbl).alias("tbl"), df[id_col].cast("bigint").alias("id"), caption_key(df[text_col]).alias("_k"))
    return rows.filter((F.col("_k") != "") & F.col("id").isNotNull()).select("tbl", "id", digest(F.col("_k")).alias("key"))


def _number(x: Decimal) -> str:
    """One text per value: digits without outer zeros, and the power of ten."""
    sign, digits, exponent = x.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    short = text.rstrip("0")
    return f"{'-' * sign}{short}e{exponent + len(text) - len(short)}" if short else "0"


def _refuse(name: str) -> None:
    raise ValueError(name)


def canonical_json(line: str | None, caption_field: str, normal) -> str | None:
    """One text for all writings of a JSON record, or None where the line is no complete record.

    Spaces, line ends and commas around it are ignored. Field order does not matter, a field given twice counts with its
    last value, numbers count by value, strings as they are, entries of ``caption_field`` as captions (those without
    letters or digits and nulls not at all), in their order.
    """
    if line is None:
        return None
    try:
        record = json.loads(line.strip(AROUND), parse_float=Decimal, parse_int=Decimal, parse_constant=_refuse)
        if not isinstance(record, dict):
            return None

        def out(x) -> str:
            if isinstance(x, Decimal):
                return _number(x)
            if isinstance(x, dict):
                return "{" + ",".join(f"{json.dumps(k)}:{captions(v) if k == caption_field and isinstance(v, list) else out(v)}" for k, v in sorted(x.items())) + "}"
            if isinstance(x, list):
                return "[" + ",".join(map(out, x)) + "]"
            return json.dumps(x)

        def captions(entries: list) -> str:
            keys = [normal(e) if isinstance(e, str) else e for e in entries if e is not None]
            return "[" + ",".join(out(k) for k in keys if k != "") + "]"

        return out(record)
    except (ValueError, RecursionError, ArithmeticError):
        return None


def json_record_keys(df: DataFrame, tbl: str, id_col: str, line_col: str, caption_field: str = "cap") -> DataFrame:
    """Keys of rows by their JSON record; incomplete lines, other JSON values, nulls and null ids have no key."""
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[line_col].alias("_line")).filter(F.col("id").isNotNull() & F.col("_line").isNotNull())

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        other = regex.compile(r"[^\p{L}\p{N}]+")

        def normal(text: str) -> str:
            return other.sub("", text).lower()

        for f in frames:
            f["_k"] = [canonical_json(x, caption_field, normal) for x in f["_line"]]
            yield f.loc[f["_k"].notna(), ["id", "_k"]]

    keyed = rows.mapInPandas(run, "id bigint, _k string")
    return keyed.select(F.lit(tbl).alias("tbl"), "id", digest(F.col("_k")).alias("key"))


# --- the ledger -----------------------------------------------------------------------------------------------------


class CopyLedger:
    """Counts of canonical keys in buckets, kept over batches. Columns: tbl, key, copies, keep_id, bucket.

    Files lie in ``path/v<version>/bucket=<b>``; the newest complete version of each bucket holds. The number of buckets is
    chosen once, from the rows expected, and kept in ``path/buckets``. A bucket that outgrows ``BUCKET_ROWS`` is written by
    several tasks.
    """

    SCHEMA = "tbl string, key binary, copies bigint, keep_id bigint, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int, version: int = 0, newest: dict[int, int] | None = None):
        self.spark, self.path, self.buckets, self.version, self.newest = spark, path, buckets, version, newest or {}

    @classmethod
    def create(cls, spark: SparkSession, rows: int = 0, buckets: int | None = None, path: str | None = None) -> "CopyLedger":
        """An empty ledger for about ``rows`` records, or with the given number of buckets."""
        path = path or fresh_path(spark, "ledger")
        if buckets is None:
            buckets = max(BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        out = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop(f"{path}/buckets"), False)
        out.writeInt(buckets)
        out.close()
        return cls(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None) -> "CopyLedger":
        """The ledger as its last complete update left it; versions without a success mark are passed over. ``buckets`` may
        be given to make sure that the ledger has that many."""
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        kept = fs.open(hadoop(f"{path}/buckets"))
        held = kept.readInt()
        kept.close()
        if buckets not in (None, held):
            raise ValueError(f"the ledger in {path} has {held} buckets, not {buckets}")
        done = {int(s.getPath().getParent().getName()[1:]) for s in fs.globStatus(hadoop(f"{path}/v*/_SUCCESS"))}
        newest: dict[int, int] = {}
        for s in fs.globStatus(hadoop(f"{path}/v*/bucket=*")):
            v, b = int(s.getPath().getParent().getName()[1:]), int(s.getPath().getName()[7:])
            if v in done:
                newest[b] = max(v, newest.get(b, 0))
        return cls(spark, path, held, max(done, default=0), newest)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, only: set[int] | None = None) -> DataFrame:
        """All of the ledger, or the given buckets of it."""
        held = [f"{self.path}/v{v}/bucket={b}" for b, v in sorted(self.newest.items()) if only is None or b in only]
        if not held:
            return self.spark.createDataFrame([], self.SCHEMA)
        # Bucket folders lie under several versions, so the bucket is taken from the key instead of the folder.
        rows = self.spark.read.schema("tbl string, key binary, copies bigint, keep_id bigint").parquet(*held)
        return rows.withColumn("bucket", self.bucket(F.col("key")))

    def update(self, batch: DataFrame) -> "CopyLedger":
        """Add the rows (tbl, id, key) of a batch; returns the ledger at its next version.

        The batch is aggregated first, so a hot key leaves each map task as one row. Only the buckets it touches are read
        and written again.
        """
        new = batch.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).withColumn("bucket", self.bucket(F.col("key")))
        writers = 1
        if self.newest:
            new = materialize(new, "ledger-batch")
            touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most as many as there are buckets
            held = self.read(touched)
            # The rows of a bucket go to one task while it is of the size it was made for.
            writers = max(1, -(-(new.count() + held.count()) // (max(1, len(touched)) * BUCKET_ROWS)))
            both = held.join(new, ["tbl", "key", "bucket"], "full_outer")
            new = both.select("tbl", "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("keep_id", "first").alias("keep_id"), "bucket")
        else:
            new = new.select("tbl", "key", F.col("n").alias("copies"), F.col("first").alias("keep_id"), "bucket")
        version, where = self.version + 1, f"{self.path}/v{self.version + 1}"
        new = new.repartition("bucket") if writers == 1 else new.repartition(max(1, len(touched)) * writers, F.col("bucket"), F.pmod(F.hash("key"), F.lit(writers)))
        new.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(where)
        if not self.newest:
            touched = {r.bucket for r in self.spark.read.schema("tbl string, bucket int").parquet(where).select("bucket").distinct().collect()}
        return CopyLedger(self.spark, self.path, self.buckets, version, self.newest | dict.fromkeys(touched, version))


def members_of(keyed: DataFrame, ledger: DataFrame, rows: int, members: str = "copies") -> DataFrame:
    """(tbl, keep_id, dup_id) for every row of a group of two or more but its first; ``members`` counts the group, which
    may be more than the copies of one key.

    Keys of more than rows / HEAVY_PART copies, at most HEAVY_PART of them, go by broadcast, so no task gathers a hot
    group; the others are joined on the key.
    """
    repeated = ledger.filter(F.col(members) > 1)
    heavy_from = max(1, rows // HEAVY_PART)
    heavy = F.broadcast(repeated.filter(F.col("copies") > heavy_from).select("tbl", "key", F.col("keep_id").alias("_heavy")))
    marked = keyed.join(heavy, ["tbl", "key"], "left")
    hot = marked.filter("_heavy is not null").select("tbl", F.col("_heavy").alias("keep_id"), "id")
    cold = marked.filter("_heavy is null").join(repeated.filter(F.col("copies") <= heavy_from).select("tbl", "key", "keep_id"), ["tbl", "key"])
    both = hot.unionByName(cold.select("tbl", "keep_id", "id"))
    return both.filter("id <> keep_id").select("tbl", "keep_id", F.col("id").alias("dup_id"))


def record_keys(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = lambda name, *columns: spread(table(spark, sf_dir, name).select(*columns))
    return {
        "toy_filter": array_record_keys(read("toy_filter", "clip_id", "cap"), "toy_filter", "clip_id", "cap"),
        "prompt_table": text_record_keys(read("prompt_table", "prompt_id", "prompt"), "prompt_table", "prompt_id", "prompt"),
        "manifest_raw": json_record_keys(read("manifest_raw", "raw_id", "line"), "manifest_raw", "raw_id", "line"),
    }


def build_ledger(spark: SparkSession, batches: Iterable[DataFrame], rows: int = 0) -> CopyLedger:
    ledger = CopyLedger.create(spark, rows)
    for batch in batches:
        ledger = ledger.update(batch)
    return ledger


def _keyed_and_ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, CopyLedger, int]:
    keyed = materialize(reduce(DataFrame.unionByName, record_keys(spark, sf_dir).values()), "record-keys")
    rows = keyed.count()
    # Two deliveries of the same tables: keys come in twice and must meet what the ledger already holds.
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    ledger = build_ledger(spark, [keyed.filter(half == 0), keyed.filter(half == 1)], rows)
    return keyed, ledger, rows


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one table that are the same: the group's smallest key and each other member."""
    keyed, ledger, rows = _keyed_and_ledger(spark, sf_dir)
    return members_of(keyed, ledger.read(), rows)


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct record once, by its earliest row, with the number of its copies."""
    _, ledger, _ = _keyed_and_ledger(spark, sf_dir)
    return ledger.read().select("tbl", "keep_id", "copies")


_KEYS = r"""
WITH clips AS (SELECT 'toy_filter' AS tbl, clip_id AS id, list_sort(list_distinct(list_filter(list_transform(cap, lambda c: lower(regexp_replace(c, '[^\p{L}\p{N}]+', '', 'g'))), lambda k: k <> ''))) AS k FROM toy_filter),
texts AS (SELECT 'prompt_table' AS tbl, prompt_id AS id, lower(regexp_replace(prompt, '[^\p{L}\p{N}]+', '', 'g')) AS k FROM prompt_table),
lines AS (SELECT raw_id, regexp_replace(line, '^[\s,]+|[\s,]+$', '', 'g') AS line FROM manifest_raw),
docs AS (SELECT raw_id, CASE WHEN json_valid(line) THEN line END AS j FROM lines),
records AS (SELECT raw_id, j, from_json(j, '{"cut": ["DOUBLE"], "crop": ["DOUBLE"], "fps": "DOUBLE", "num_frames": "DOUBLE", "resolution": {"height": "DOUBLE", "width": "DOUBLE"}, "cap": ["VARCHAR"], "path": "VARCHAR"}') AS r FROM docs WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
manifest AS (SELECT 'manifest_raw' AS tbl, raw_id AS id, (list_sort(json_keys(j)), list_sort(json_keys(j, '$.resolution')), r.cut, r.crop, r.fps, r.num_frames, r.resolution.height, r.resolution.width, r.path,
  list_filter(list_transform(r.cap, lambda c: lower(regexp_replace(c, '[^\p{L}\p{N}]+', '', 'g'))), lambda k: k <> ''))::VARCHAR AS k FROM records),
keyed AS (SELECT tbl, id, array_to_string(k, ' ') AS k FROM clips WHERE len(k) > 0 UNION ALL SELECT * FROM texts WHERE k <> '' UNION ALL SELECT * FROM manifest),
counted AS (SELECT *, min(id) OVER w AS keep_id, count(*) OVER w AS copies FROM keyed WINDOW w AS (PARTITION BY tbl, k))
"""

#: Checks p1 for manifest records of the fields that the test tables use; the query itself compares records of any fields.
SQL = {
    "p1_found": _KEYS + "SELECT tbl, keep_id, id AS dup_id FROM counted WHERE id <> keep_id",
    "p1_counts": _KEYS + "SELECT DISTINCT tbl, keep_id, copies FROM counted",
}
