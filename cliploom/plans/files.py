"""Queries through files: each writes what its reader is to find into the session's work folder and reads it back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import shapes
from cliploom.operators import leaderboard
from cliploom.plans.scoring import _scores
from cliploom.session import fresh_path, table
from cliploom.sources import files, manifests, prompts, results, sinks


def _places(spark: SparkSession, sf_dir: str) -> list:
    """The nations and their regions: 25 rows, a fixed table."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").join(F.broadcast(r), "n_regionkey").orderBy("n_nationkey").collect()


def _samples(spark: SparkSession, sf_dir: str) -> list:
    """The language samples, a fixed table of 120 rows, in order."""
    return table(spark, sf_dir, "lang_sample").select("sample_id", "lang", "text").orderBy("sample_id").collect()


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a folder and sizes of its .mp4 files; other files are not listed."""
    root = fresh_path(spark, "listing")
    for p in _places(spark, sf_dir):
        files.write_text(spark, f"{root}/{p.n_regionkey}/clips/{p.n_nationkey}.mp4", p.n_name)
        files.write_text(spark, f"{root}/{p.n_regionkey}/clips/{p.n_nationkey}.txt", "not a clip")
    return manifests.list_files(spark, root, "*.mp4").select(F.regexp_extract("path", r"([^/]+/clips/[^/]+)$", 1).alias("path"), "length")


def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by type of source: those of one shape, of one size, and all."""
    listing = table(spark, sf_dir, "latent_sample").select(F.col("file_path").alias("path"))
    parts = [manifests.folder_samples(listing, "gan", (33, 384, 640)), manifests.folder_samples(listing, "gan", (33, 384, 640), any_length=True).withColumn("source_type", F.lit("gan_any")), manifests.folder_samples(listing, "ode"), manifests.folder_samples(listing, "text")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def captions_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of a tab-separated file; lines of two fields do not count and a later line replaces an earlier one."""
    path = fresh_path(spark, "captions") + ".tsv"
    lines = ["video\tsize\tcaption"]
    for r in _samples(spark, sf_dir):
        lines += [f"clip{r.sample_id % 50}.mp4\t5\t{r.text}", f"short{r.sample_id}.mp4\t5"]
    files.write_text(spark, path, "\n".join(lines) + "\n")
    return prompts.read_captions_tsv(spark, path).select("video", F.get("fields", F.lit(2)).alias("caption"))


def scene_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of annotation files with and without scenes, the second file replacing what the first says of a video."""
    root = fresh_path(spark, "scenes")
    rows = _samples(spark, sf_dir)
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    files.write_text(spark, f"{root}/a.csv", "\n".join(["videoFile,caption,scene"] + [f"v{r.sample_id}.mp4,{quoted(r.text)},{r.lang}" for r in rows]))
    files.write_text(spark, f"{root}/b.csv", "\n".join(["videoFile,caption"] + [f"v{r.sample_id}.mp4,{quoted(r.lang)}" for r in rows if r.sample_id % 3 == 0]))
    return prompts.read_scene_captions(spark, f"{root}/a.csv, {root}/none.csv, {root}/b.csv")


def sniffed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label tables in three dialects: commas, tabs, and a separator that only the first line shows."""
    root = fresh_path(spark, "dialects")
    files.write_text(spark, f"{root}/a.csv", "id,prompt\n" + "".join(f"a{r.sample_id},{r.lang}\n" for r in _samples(spark, sf_dir)))
    files.write_text(spark, f"{root}/b.tab", "videoFile\tcaption\n" + "".join(f"b{r.sample_id}.mp4\t{r.lang}\n" for r in _samples(spark, sf_dir)))
    files.write_text(spark, f"{root}/c.txt", "video_name;prompt;caption_original\n" + "".join(f"c{r.sample_id}.mp4;{r.lang};x\n" for r in _samples(spark, sf_dir)))
    return prompts.read_tables(spark, f"{root}/a.csv,{root}/b.tab,{root}/c.txt").select("id", "prompt", "image_name", "prompt_original")


def _prompt_file(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "lines") + "/prompts.txt"
    lines = [line for r in _samples(spark, sf_dir) for line in ([f"  {r.text}\t"] if r.lang != "de" else [" \t", r.text])]
    files.write_text(spark, path, "\n".join(lines) + "\n\n")
    return path


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.prompt_lines(spark, _prompt_file(spark, sf_dir)).select("line_no", "prompt")


def remaining_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a text file, numbered with its blank lines, without those that are done: every fifth number."""
    done = spark.range(0, 500, 5).select(F.format_string("prompts_%05d", "id").alias("uttid"))
    return prompts.remaining_lines(spark, _prompt_file(spark, sf_dir), done).select("uttid", "prompt")


def results_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric documents of models; an unknown metric is left out and a broken document is reported."""
    root = fresh_path(spark, "results")
    for p in _places(spark, sf_dir):
        items = [{"id": i, "video_name": f"{i}.mp4"} for i in range(p.n_nationkey)]
        doc = {"metric": "aesthetic", "average_score": p.n_nationkey / 32, "num_videos": len(items), "per_video_results": items}
        files.write_text(spark, f"{root}/model{p.n_nationkey}/aesthetic_results.json", json.dumps(doc, indent=1))
        files.write_text(spark, f"{root}/model{p.n_nationkey}/other_results.json", json.dumps(doc))
        files.write_text(spark, f"{root}/model{p.n_nationkey}/semantic_results.json", "{" if p.n_nationkey % 2 else json.dumps({**doc, "average_score": None, "average_drift_score": 0.25}))
    d = results.read_results(spark, f"{root}/*/*_results.json", ["aesthetic", "semantic"])
    return d.select("model", "metric", "average_score", "average_drift_score", "num_videos", F.size(F.coalesce("items", F.array().cast("array<struct<id:bigint,video_name:string,prompt:string>>"))).alias("items"), "unreadable")


def merged_results_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of each model's merged document; a folder without one and a broken one give nothing."""
    root = fresh_path(spark, "merged")
    for p in _places(spark, sf_dir):
        k = p.n_nationkey
        score = {"raw_score": k / 64, "normalized_score": k / 32, "rating": k % 10 + 1}
        doc = {"summary": {"non_drifting": {"aesthetic": score}, "drifting": {"drifting_aesthetic": score} if k % 2 else {}, **({"total_weighted_rating": k / 4} if k % 3 else {})}}
        files.write_text(spark, f"{root}/m{k}/{'merged_results.json' if k < 24 else 'else.json'}", "{broken" if k == 7 else json.dumps(doc))
    return results.read_merged(spark, f"{root}/*/merged_results.json", "rating")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts written as CSV with a column added and read back, whole texts; empty ones come back as nulls."""
    path = fresh_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "prompt_table").select("prompt_id", "prompt", "id"), path, caption_original=F.col("prompt"), id=F.lit("not added again"))
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema("prompt_id bigint, prompt string, id string, caption_original string").csv(path)
    return back.select("prompt_id", "id", F.md5("prompt").alias("prompt"), F.md5("caption_original").alias("caption_original"))


def samples_written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written twice into folders by shape: the second time adds none."""
    path = fresh_path(spark, "samples")
    s = table(spark, sf_dir, "latent_sample").filter("num_frame is not null").groupBy("uttid").agg(F.min_by(F.struct("num_frame", "height", "width"), "sample_id").alias("s")).select("uttid", "s.*")
    added = [sinks.write_samples(s.filter("height <= 480"), path), sinks.write_samples(s, path), sinks.write_samples(s, path)]
    return spark.read.parquet(path).select("uttid", "num_frame", "height", "width", F.lit(added[2]).cast("bigint").alias("added_last"))


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each shape as one indented document, read back."""
    path = fresh_path(spark, "shapes") + ".json"
    sinks.write_json_document(table(spark, sf_dir, "latent_sample").groupBy("height", "width").agg(F.count(F.lit(1)).alias("samples")), path)
    return spark.read.schema("height int, width int, samples bigint").option("multiLine", True).json(path)


def statistics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of counts as lines of text."""
    d = table(spark, sf_dir, "latent_sample").agg(F.count(F.lit(1)).alias("samples"), F.sum("num_frame").alias("frames"))
    path = fresh_path(spark, "report") + ".txt"
    files.write_text(spark, path, sinks.statistics_report(d, "Samples"))
    return prompts.prompt_lines(spark, path).select("line_no", "prompt")


def leaderboard_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = leaderboard.metric_means(_scores(spark, sf_dir)).groupBy("model").agg(F.avg("average_score").alias("average_score"))
    return sinks.leaderboard_metadata(board, "2026-01-01").select(F.col("Property").alias("property"), F.col("Value").alias("value"))


def validation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of a page of validation videos, in the page's order; one video for each nation."""
    n = table(spark, sf_dir, "nation")
    path = F.format_string("global_step%d_validation_video_%d_%s.mp4", F.col("n_regionkey") * 100, "n_nationkey", F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")))
    page = sinks.validation_page(manifests.validation_videos(n.select(path.alias("path"))), "Runs <1>")
    at = fresh_path(spark, "page") + ".html"
    files.write_text(spark, at, page.replace('<div class="step-header">', "\n").replace('<div class="card">', "\n"))
    return prompts.prompt_lines(spark, at).filter("prompt like '<video%'").select("line_no", F.regexp_extract("prompt", r"<div>(#.*?)</div>", 1).alias("label"), F.regexp_extract("prompt", r"</div><div>(.*?)</div>", 1).alias("slug"))


def frame_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle frames of each clip by a reader that takes a byte for a frame; an empty clip cannot be read."""
    root = fresh_path(spark, "clips")
    for p in _places(spark, sf_dir):
        files.write_text(spark, f"{root}/{p.n_nationkey}.mp4", "" if p.n_nationkey == 3 else p.n_name)

    def decode(content: bytes, frames: list[int]):
        if not content:
            raise ValueError("no frames")
        return [(i, content[f]) for i, f in enumerate(frames)]

    frames = shapes.middle_frames(4, F.length("content").cast("int"))
    d = files.decoded(files.read_contents(spark, root, "*.mp4"), decode, "place int, frame int", frames)
    return d.select(shapes.stem(F.col("path")).cast("bigint").alias("n_nationkey"), "place", "frame")


def metadata_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cached listing holds after its source changed, and after it was built anew."""
    path = fresh_path(spark, "cache")
    s = table(spark, sf_dir, "latent_sample").groupBy("height", "width").agg(F.count(F.lit(1)).alias("samples"))
    first = files.built_once(spark, path, lambda: s)
    kept = files.built_once(spark, path, lambda: s.limit(0)).count() == first.count()
    anew = files.built_once(spark, path + "-2", lambda: s.limit(0))
    anew = files.built_once(spark, path + "-2", lambda: s.withColumn("samples", F.col("samples") * 2), rebuild=True)
    return first.select("height", "width", "samples", F.lit(kept).alias("kept")).join(anew.withColumnRenamed("samples", "anew"), ["height", "width"])


def detected_video_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos of a label table by whichever of the known columns it has, its required columns being there."""
    p = prompts.require_columns(table(spark, sf_dir, "prompt_table"), "id", "prompt")
    return p.select("prompt_id", F.col(prompts.video_column(p)).alias("video"))


_LINES = r"""
WITH s AS (SELECT sample_id, lang, text, unnest(CASE WHEN lang = 'de' THEN [0, 1] ELSE [1] END) AS part FROM lang_sample),
n AS (SELECT *, row_number() OVER (ORDER BY sample_id, part) - 1 AS line FROM s)
"""
_STATS = "SELECT CAST(count(*) AS VARCHAR) AS samples, CAST(sum(num_frame) AS VARCHAR) AS frames FROM latent_sample"

QUERIES = {
    "listed_files": (listed_files, "SELECT n_regionkey || '/clips/' || n_nationkey || '.mp4' AS path, strlen(n_name) AS length FROM nation"),
    "source_types": (source_types, r"""
WITH l AS (SELECT file_path, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.pt$', '') AS uttid, regexp_replace(regexp_replace(file_path, '[^/]*$', ''), '/+$', '') AS dataset_name FROM latent_sample WHERE file_path LIKE '%.pt')
SELECT uttid, dataset_name, file_path, 'gan' AS source_type FROM l WHERE uttid LIKE '%\_33\_384\_640' ESCAPE '\' UNION ALL SELECT uttid, dataset_name, file_path, 'gan_any' FROM l WHERE uttid LIKE '%\_384\_640' ESCAPE '\'
UNION ALL SELECT uttid, dataset_name, file_path, t FROM l, (VALUES ('ode'), ('text')) v(t)"""),
    "captions_tsv": (captions_tsv, "SELECT 'clip' || (sample_id % 50) AS video, arg_max(text, sample_id) AS caption FROM lang_sample GROUP BY 1"),
    "scene_captions": (scene_captions, "SELECT 'v' || sample_id AS video, CASE WHEN sample_id % 3 = 0 THEN 'outdoor' ELSE lang END AS action_class, CASE WHEN sample_id % 3 = 0 THEN lang ELSE text END AS prompt FROM lang_sample"),
    "sniffed_table": (sniffed_table, "SELECT p || sample_id AS id, lang AS prompt, p || sample_id || '.jpg' AS image_name, CASE WHEN p = 'c' THEN 'x' END AS prompt_original FROM lang_sample, (VALUES ('a'), ('b'), ('c')) v(p)"),
    "text_lines": (text_lines, _LINES + "SELECT row_number() OVER (ORDER BY sample_id) - 1 AS line_no, trim(text) AS prompt FROM lang_sample"),
    "remaining_text_lines": (remaining_text_lines, _LINES + "SELECT printf('prompts_%05d', line) AS uttid, trim(text) AS prompt FROM n WHERE part = 1 AND line % 5 <> 0"),
    "results_scan": (results_scan, """
WITH m AS (SELECT 'model' || n_nationkey AS model, n_nationkey AS k FROM nation)
SELECT model, 'aesthetic' AS metric, k / 32.0::DOUBLE AS average_score, CAST(NULL AS DOUBLE) AS average_drift_score, CAST(k AS BIGINT) AS num_videos, CAST(k AS INTEGER) AS items, false AS unreadable FROM m
UNION ALL SELECT model, 'semantic', NULL, CASE WHEN k % 2 = 0 THEN 0.25 END, CASE WHEN k % 2 = 0 THEN k END, CASE WHEN k % 2 = 0 THEN k ELSE 0 END, k % 2 = 1 FROM m"""),
    "merged_results_scan": (merged_results_scan, """
WITH m AS (SELECT 'm' || n_nationkey AS model, n_nationkey AS k FROM nation WHERE n_nationkey < 24 AND n_nationkey <> 7)
SELECT model, 'aesthetic' AS metric, CAST(k % 10 + 1 AS DOUBLE) AS score FROM m UNION ALL SELECT model, 'drifting_aesthetic', k % 10 + 1 FROM m WHERE k % 2 = 1 UNION ALL SELECT model, 'total_weighted_rating', k / 4.0::DOUBLE FROM m WHERE k % 3 <> 0"""),
    "csv_round_trip": (csv_round_trip, "SELECT prompt_id, id, md5(nullif(prompt, '')) AS prompt, md5(nullif(prompt, '')) AS caption_original FROM prompt_table"),
    "samples_written_once": (samples_written_once, """
WITH s AS (SELECT uttid, arg_min({'f': num_frame, 'h': height, 'w': width}, sample_id) AS s FROM latent_sample WHERE num_frame IS NOT NULL GROUP BY 1)
SELECT uttid, s.f AS num_frame, s.h AS height, s.w AS width, CAST(0 AS BIGINT) AS added_last FROM s"""),
    "json_document": (json_document, "SELECT height, width, count(*) AS samples FROM latent_sample GROUP BY 1, 2"),
    "statistics_lines": (statistics_lines, f"WITH s AS ({_STATS}) SELECT CAST(0 AS BIGINT) AS line_no, 'Samples' AS prompt UNION ALL SELECT 1, '=======' UNION ALL SELECT 2, 'samples: ' || samples FROM s UNION ALL SELECT 3, 'frames: ' || frames FROM s"),
    "leaderboard_metadata": (leaderboard_metadata, "SELECT * FROM (VALUES ('timestamp', '2026-01-01'), ('num_models', '5'), ('num_metrics', '1'), ('filtered', 'No'), ('format', 'Percentage')) v(property, value)"),
    "validation_grid": (validation_grid, """
WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, translate(lower(n_name), '_', ' ') AS s, row_number() OVER (ORDER BY n_regionkey, n_nationkey) + dense_rank() OVER (ORDER BY n_regionkey) AS line FROM nation)
SELECT line AS line_no, '#' || k || ' — Validation' AS label, s AS slug FROM n"""),
    "frame_reader": (frame_reader, """
WITH n AS (SELECT n_nationkey, n_name, strlen(n_name) AS len, unnest(range(0, 4)) AS place FROM nation WHERE n_nationkey <> 3),
e AS (SELECT *, CAST(floor(place * (len / 4.0::DOUBLE)) AS BIGINT) AS a, CASE WHEN place = 3 THEN len ELSE CAST(floor((place + 1) * (len / 4.0::DOUBLE)) AS BIGINT) END AS b FROM n)
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(place AS INTEGER) AS place, CAST(ascii(n_name[(a + b - 1) // 2 + 1]) AS INTEGER) AS frame FROM e"""),
    "metadata_cache": (metadata_cache, "SELECT height, width, count(*) AS samples, true AS kept, count(*) * 2 AS anew FROM latent_sample GROUP BY 1, 2"),
    "detected_video_column": (detected_video_column, "SELECT prompt_id, id AS video FROM prompt_table"),
}
