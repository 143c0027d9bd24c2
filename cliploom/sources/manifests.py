"""Clip manifests and sample listings: reading, deriving, bucketing, and reasons for leaving rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import dims, shapes

MANIFEST = "cut array<int>, crop array<int>, fps double, num_frames int, resolution struct<height:int,width:int>, cap array<string>, path string"
#: Literal prefixes that manifests write before a video's own path, removed wherever they occur.
PATH_PREFIXES = ("videos_clip_v1/", "./", "videos/")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest written as one JSON array; records that do not fit the schema are kept in _corrupt_record."""
    return spark.read.schema(MANIFEST + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_manifest_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Manifest records as received, one JSON text a row; blanks, line ends and commas around it are dropped, unreadable
    lines have null fields."""
    clean = F.regexp_replace(F.col(column), r"^[\s,]+|[\s,]+$", "")
    return lines.withColumn("_r", F.from_json(clean, MANIFEST)).select("*", "_r.*").drop("_r")


def derived(clips: DataFrame) -> DataFrame:
    """Adds num_frame (from the cut), width and height (from the crop), prompt (first caption), video_path and uttid."""
    out = clips.withColumn("num_frame", shapes.span(F.col("cut"))).withColumn("width", shapes.span(F.col("crop"))).withColumn("height", shapes.span(F.col("crop"), 2, 3))
    out = out.withColumn("prompt", F.get("cap", F.lit(0))).withColumn("video_path", shapes.without(F.col("path"), *PATH_PREFIXES))
    return out.withColumn("uttid", shapes.uttid(F.col("path"), F.col("cut")))


def long_enough(rows: DataFrame, frames: int, column: str = "num_frame") -> DataFrame:
    return rows.filter(F.col(column) >= frames)


def allowed_shape(rows: DataFrame, allowed: list[tuple[int, int]]) -> DataFrame:
    """Rows whose (height, width) is in a fixed list."""
    either = F.lit(False)
    for h, w in allowed:
        either = either | ((F.col("height") == h) & (F.col("width") == w))
    return rows.filter(either)


def bucketed(rows: DataFrame, stride: int = 1) -> DataFrame:
    """Adds bucket_frames, bucket_height, bucket_width; rows without a shape fall out."""
    rows = rows.filter("num_frame is not null and height is not null and width is not null")
    nearest = shapes.nearest_resolution(F.col("height"), F.col("width"))
    frames = shapes.ceil_div(F.col("num_frame"), stride).cast("int")
    lengths = dims.LENGTHS_1 if stride == 1 else dims.LENGTHS_2
    return rows.withColumn("bucket_frames", shapes.nearest_length(frames, lengths)).withColumn("bucket_height", nearest["height"]).withColumn("bucket_width", nearest["width"])


def skip_reasons(clips: DataFrame, frames: int, base_fps: float) -> DataFrame:
    """Adds reason: why the training loader would leave a clip out, or "kept". Nothing is dropped silently."""
    rows = derived(clips)
    missing = F.col("path").isNull() | F.col("num_frame").isNull() | F.col("height").isNull() | F.col("width").isNull()
    stride = shapes.fps_stride(F.col("fps"), base_fps)
    short = shapes.nearest_length(F.col("num_frame"), dims.LENGTHS_1) * stride >= F.col("num_frame")
    reason = F.when(missing, "incomplete").when(F.col("num_frame") < frames, "too short").when(F.coalesce(F.trim("prompt"), F.lit("")) == "", "no caption")
    reason = reason.when(F.col("fps").isNull(), "no frame rate").when(short, "too few frames at this rate").otherwise("kept")
    return rows.withColumn("reason", reason)


_NAME = r"^(.*)_(\d+)_(\d+)_(\d+)\.pt$"


def latent_names(listing: DataFrame, path_col: str = "path", pattern: str = _NAME) -> DataFrame:
    """Adds uttid, num_frames, file_height, file_width and root from names uttid_frames_height_width.pt; others fall out."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    part = lambda i: F.regexp_extract(name, pattern, i)
    out = listing.filter(name.rlike(pattern)).withColumn("uttid", part(1))
    for i, c in ((2, "num_frames"), (3, "file_height"), (4, "file_width")):
        out = out.withColumn(c, part(i).try_cast("int"))
    return out.withColumn("root", F.regexp_extract(path_col, r"^(.*)/[^/]*$", 1))


def folder_samples(listing: DataFrame, source_type: str, shape: tuple[int, int, int] | None = None, any_length: bool = False, path_col: str = "path") -> DataFrame:
    """(uttid, dataset_name, file_path, source_type) of the .pt files of a folder's listing; the uttid is the whole stem. Of
    type "gan" only files of the shape (frames, height, width) count, or of its height and width with ``any_length``."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    rows = listing.filter(name.endswith(".pt"))
    if source_type == "gan":
        frames, height, width = shape
        ends = rf"_{height}_{width}\.pt$" if any_length else rf"_{frames}_{height}_{width}\.pt$"
        rows = rows.filter(name.rlike(ends))
    return rows.select(F.regexp_replace(name, r"\.pt$", "").alias("uttid"), F.regexp_extract(path_col, r"^(.*?)/*[^/]*$", 1).alias("dataset_name"), F.col(path_col).alias("file_path"), F.lit(source_type).alias("source_type"))


def list_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder).select("path", "length", "modificationTime")


def validation_videos(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """(step, kind, idx, slug) from names global_step<n>_[final_step_]validation_video_<i>_<slug>.mp4."""
    pattern = r"global_step(\d+)_((?:final_step_)?validation)_video_(\d+)_(.+)\.mp4$"
    part = lambda i: F.regexp_extract(path_col, pattern, i)
    rows = listing.filter(F.col(path_col).rlike(pattern))
    return rows.select(path_col, part(1).cast("bigint").alias("step"), part(2).alias("kind"), part(3).cast("bigint").alias("idx"), F.translate(part(4), "_", " ").alias("slug"))


def checkpoint_videos(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """(step, idx) from names checkpoint-<step>_<idx>.mp4 or, failing that, any name ending in <step>_<idx>.mp4."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    both: list[Column] = []
    for i in (1, 2):
        strict, loose = F.regexp_extract(name, r"^checkpoint-(\d+)_(\d+)\.mp4$", i), F.regexp_extract(name, r"^.*?(\d+)_(\d+)\.mp4$", i)
        both.append(F.coalesce(F.nullif(strict, F.lit("")), F.nullif(loose, F.lit(""))).try_cast("bigint"))
    return listing.select(path_col, both[0].alias("step"), both[1].alias("idx")).filter("step is not null")


def evaluation_videos(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """(video_id) from names <id>_*_ori*.mp4; order by it for the numeric file order."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    rows = listing.filter(name.rlike(r"^[^/]*_[^/]*_ori[^/]*\.mp4$"))
    return rows.select(path_col, F.regexp_extract(name, r"^(\d+)_", 1).try_cast("bigint").alias("video_id")).filter("video_id is not null")


def action_files(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """(video, start_frame, end_frame, keys, mouse) from Keys_<keys>_Mouse_<mouse>/<video>_frames_<start>-<end>.mp4."""
    from cliploom.functions.actions import action_of_directory

    pattern = r"(Keys_[^/]+_Mouse_[^/]+)/([^/]+)_frames_(\d+)-(\d+)\.[A-Za-z0-9]+$"
    part = lambda i: F.regexp_extract(path_col, pattern, i)
    rows = listing.filter(F.col(path_col).rlike(pattern)).withColumn("_a", action_of_directory(part(1)))
    return rows.select(part(2).alias("video"), part(3).cast("int").alias("start_frame"), part(4).cast("int").alias("end_frame"), F.col("_a.keys").alias("keys"), F.col("_a.mouse").alias("mouse"))
