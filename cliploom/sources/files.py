"""Files as such: whether they exist, small ones written by the driver, contents decoded by a function of the caller, and
tables built once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file written by the driver, in place of any before; for documents and pages."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def decoded(files: DataFrame, decode: Callable[[bytes, list[int]], Iterable[tuple]], schema: str, frames: Column | None = None) -> DataFrame:
    """(path, columns of ``schema``): what ``decode`` makes of each file's content and the frames wanted of it (none for a
    null), several rows a file if it gives several. ``files`` has path and content, as the binaryFile source gives them; each
    task holds one batch of files. A file that ``decode`` raises a ValueError for has no rows."""
    names = [c.split(":")[0].split()[0] for c in schema.split(",")]
    rows = files.select("path", "content", (F.lit(None).cast("array<int>") if frames is None else frames).alias("frames"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for path, content, wanted in zip(f["path"], f["content"], f["frames"]):
                try:
                    out += [(path, *row) for row in decode(content, [] if wanted is None else [int(i) for i in wanted])]
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["path", *names])

    return rows.mapInPandas(run, f"path string, {schema}")


def read_contents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "content")


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at ``path``, built and stored there where it is missing or ``rebuild`` is asked for. A table that exists is
    not looked at for changes of its source; one whose writing broke off counts as missing."""
    if rebuild or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
