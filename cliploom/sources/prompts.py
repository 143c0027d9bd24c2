"""Prompt and label tables in their several dialects."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.functions.captions import stripped
from cliploom.functions.shapes import stem
from cliploom.sources.files import exists

#: Column names of other dialects, and what they mean here.
RENAMED = {"videoFile": "video_name", "caption": "prompt", "caption_original": "prompt_original"}
VIDEO_COLUMNS = ("videoFile", "video_name", "id")


def read_tables(spark: SparkSession, paths: str) -> DataFrame:
    """Comma-separated paths of .csv, .tsv or .tab files, or others whose separator their first line shows, with a header,
    brought to one schema."""
    parts = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        sep = separator_of(spark, path)
        parts.append(normalized(spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def normalized(df: DataFrame) -> DataFrame:
    """Renames the columns of other dialects and derives id (stem of the video's name) and image_name where they lack."""
    for old, new in RENAMED.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "id" not in df.columns:
        df = df.withColumn("id", stem(F.col("video_name")))
    if "image_name" not in df.columns:
        known = F.col("video_name") if "video_name" in df.columns else F.col("id")
        df = df.withColumn("image_name", F.when(known.isNull(), "").otherwise(F.concat(stem(known), F.lit(".jpg"))))
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"columns {lacking} are missing; there are {df.columns}")
    return df


def video_column(df: DataFrame) -> str:
    """The first column of VIDEO_COLUMNS that is there."""
    for name in VIDEO_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"none of {VIDEO_COLUMNS} is among {df.columns}")


def label_records(df: DataFrame) -> DataFrame:
    """Adds text (refined prompt or else prompt) and a default action_class. Empty strings count as missing, real nulls
    stand for what other tools write as nan."""
    return df.withColumn("text", F.coalesce(F.nullif("refined_prompt", F.lit("")), "prompt")).withColumn("action_class", F.coalesce(F.nullif("action_class", F.lit("")), F.lit("scene")))


def read_captions_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(video, fields) of a tab-separated file with a header: lines of three fields or more, by the first one without .mp4; of
    a video's lines the last one holds."""
    lines = numbered_lines(spark, path).filter("line_no > 0").withColumn("fields", F.split("line", "\t")).filter(F.size("fields") >= 3)
    rows = lines.select(F.get("fields", F.lit(0)).alias("name"), "fields", F.struct("stem", "line_no").alias("place"))
    return captions_last_wins(rows, "name", "place").select("video", "fields")


def read_scene_captions(spark: SparkSession, paths: str, scene: str = "outdoor") -> DataFrame:
    """(video, action_class, prompt) of comma-separated annotation files; those that are not there are passed over with a
    warning, a file without scenes has the given one, and a video's last caption in the order of the files holds."""
    parts = []
    for i, path in enumerate(filter(None, (p.strip() for p in paths.split(",")))):
        if not exists(spark, path):
            warnings.warn(f"no captions at {path}", stacklevel=2)
            continue
        rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
        label = F.col("scene") if "scene" in rows.columns else F.lit(scene)
        place = F.struct(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("row"))
        parts.append(rows.select(F.col("videoFile").alias("name"), label.alias("action_class"), F.col("caption").alias("prompt"), place.alias("place")))
    if not parts:
        return spark.createDataFrame([], "video string, action_class string, prompt string")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return captions_last_wins(both, "name", "place").select("video", "action_class", "prompt")


def separator_of(spark: SparkSession, path: str) -> str:
    """By the file's ending, or else the separator that its first line has most often."""
    if path.lower().endswith((".tsv", ".tab")):
        return "\t"
    if path.lower().endswith(".csv"):
        return ","
    head = spark.read.text(path).head()
    return max(",\t;|", key=head[0].count) if head and head[0] else ","


def captions_last_wins(df: DataFrame, name: str, order: str) -> DataFrame:
    """One row per name without its .mp4, the last in order."""
    keyed = df.withColumn("video", F.regexp_replace(name, r"\.mp4$", ""))
    return keyed.withColumn("_r", F.row_number().over(W.partitionBy("video").orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def numbered_lines(spark: SparkSession, path: str, skip_blank: bool = False) -> DataFrame:
    """(stem, line_no, line) of text files, numbered from 0 in each file; with ``skip_blank`` lines of white space alone have
    no number and fall out. A file is read in splits: lines are counted per split, and a line's number is what the splits
    before it hold and its place in its own, so no file passes through one task."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    if skip_blank:
        rows = rows.filter(stripped(F.col("line")) != "")
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", (before - F.col("_first")).alias("_shift"))
    return rows.join(splits, ["file", "split"]).select(stem(F.col("file")).alias("stem"), (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def prompt_lines(spark: SparkSession, path: str, keep_blank_numbers: bool = False) -> DataFrame:
    """(line_no, prompt, uttid) of the non-blank lines of text files. Numbers count all lines, or the non-blank ones only."""
    rows = numbered_lines(spark, path, skip_blank=not keep_blank_numbers).withColumn("prompt", stripped(F.col("line"))).filter("prompt <> ''")
    return rows.select("line_no", "prompt", F.format_string("%s_%05d", "stem", "line_no").alias("uttid"))


def remaining_lines(spark: SparkSession, path: str, done: DataFrame) -> DataFrame:
    """The prompts of text files, numbered by all lines, whose uttid is not done yet."""
    return prompt_lines(spark, path, keep_blank_numbers=True).join(done.select("uttid"), "uttid", "left_anti")


def interactive(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, prompts, keys, mouse): refined prompts or else prompts of each key in order, and the action of its first row.
    A key is one session, so its list is short."""
    text = F.coalesce("refined_prompt", "prompt")
    first = lambda c: F.min_by(F.struct(c), F.col(order)).getField(c)  # noqa: E731  keeps a null of the first row
    rows = df.filter(F.col(key).isNotNull())
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("text"))))
    return rows.groupBy(key).agg(F.transform(listed, lambda x: x["text"]).alias("prompts"), first("action_keys").alias("keys"), first("action_mouse").alias("mouse"))
