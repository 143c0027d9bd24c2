"""Queries on caption, name and action text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import actions, captions, dims, shapes
from cliploom.session import spread, table
from cliploom.sources import prompts


def _words() -> Column:
    return F.filter(F.split(F.col("prompt"), r"\s+"), lambda w: w != "")



def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prompt_table")


def whitespace_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("prompt_id", captions.collapsed(F.col("prompt")).alias("text"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.length(captions.cleaned(F.col("text"))).alias("chars"), F.md5(captions.cleaned(F.col("text"))).alias("digest"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(captions.escaped(F.col("text"))).alias("digest"))


def strip_camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_prompts(spark, sf_dir).select("prompt_id", "prompt")).select("prompt_id", captions.strip_camera_motion(F.col("prompt")).alias("text"))


def camera_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_prompts(spark, sf_dir).select("prompt_id", "prompt")).select("prompt_id", actions.actions_to_json(actions.segments_of_caption(F.col("prompt"))).alias("segments"))


def action_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = actions.with_actions(spread(_prompts(spark, sf_dir)), 5)
    return rows.select("prompt_id", F.col("action_source").alias("source"), actions.actions_to_json(F.col("actions")).alias("actions"))


def json_list_or_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions.actions_of_json(F.col("chunk_actions_json"))
    text = F.array_join(F.transform(a, lambda x: F.concat_ws("/", x["keys"], x["mouse"])), ",")
    return _prompts(spark, sf_dir).filter("chunk_actions_json is not null").select("prompt_id", text.alias("actions"))


def dirname_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.create_map(*(F.lit(x) for n, m in actions.MOUSE_NAMES.items() for x in (m, n)))
    name = F.concat(F.lit("Keys_"), F.replace("action_keys", F.lit("+"), F.lit("_")), F.lit("_Mouse_"), F.coalesce(words[F.col("action_mouse")], F.lit("Sideways")))
    a = actions.action_of_directory(name)
    return table(spark, sf_dir, "action_segments").select("seg_id", a["keys"].alias("keys"), a["mouse"].alias("mouse"))


def action_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.lit("Chunk"), F.concat(F.lit("("), "action_keys", F.lit(").")), F.concat(F.lit("("), "action_mouse", F.lit(").")))
    a = actions.action_of_line(line)
    return table(spark, sf_dir, "action_segments").select("seg_id", a["keys"].alias("keys"), a["mouse"].alias("mouse"))


def even_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each prompt over five places more than it has words, and over nine places."""
    rows = _prompts(spark, sf_dir).select("prompt_id", _words().alias("w")).filter(F.size("w") > 0)
    return rows.select("prompt_id", F.array_join(actions.spread(F.col("w"), F.size("w") + 5), " ").alias("words"), F.array_join(actions.spread(F.col("w"), 9), " ").alias("over_9"))


def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prompts(spark, sf_dir).select("prompt_id", _words().alias("w")).filter(F.size("w") > 0)
    return rows.select("prompt_id", F.array_join(shapes.padded(F.col("w"), 60), " ").alias("words"), actions.chunk_action(F.col("w"), F.lit(99)).alias("beyond"))


def ordered_prompt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of each video in order and its first action, as the interactive reader collects them."""
    return prompts.interactive(_prompts(spark, sf_dir), "id", "prompt_id").select("id", F.md5(F.array_join("prompts", "|", "")).alias("digest"), F.size("prompts").alias("n"), "keys", "mouse")


def prompt_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    dialect = _prompts(spark, sf_dir).select(F.concat("id", F.lit(".mp4")).alias("videoFile"), F.col("prompt").alias("caption"), F.col("prompt_original").alias("caption_original"))
    return prompts.normalized(dialect).select("id", "image_name", F.md5(F.coalesce("prompt", F.lit(""))).alias("digest"))


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.label_records(_prompts(spark, sf_dir)).select("prompt_id", "text", "action_class")


def url_stem_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "toy_filter").select("clip_id", shapes.stem(F.col("path")).alias("stem"), shapes.extension(F.col("path")).alias("extension"))


def title_case_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in [*dims.ALIASES, "other_metric"]], "name string")
    return names.select("name", captions.canonical_metric(F.col("name")).alias("metric"), captions.title(captions.canonical_metric(F.col("name"))).alias("title"))


def prefix_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("videos_clip_v1/", "v1:"), ("./videos/", "here:"), ("videos/", "v:")]
    return table(spark, sf_dir, "toy_filter").select("clip_id", captions.renamed_prefix(F.col("path"), rules).alias("renamed"))


def template_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = captions.filled("Rate these ##NUM_FRAMES## frames.", "NUM_FRAMES", F.col("num_frames"))
    return table(spark, sf_dir, "toy_filter").select("clip_id", filled.alias("text"), F.base64(F.encode("path", "UTF-8")).alias("encoded"))


def id_token_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_prompt").select("id", F.concat(F.lit("<clip> "), "prompt").alias("prompt"))


_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]+$', '')"
_W = r"WITH w AS (SELECT *, list_filter(regexp_split_to_array(prompt, '\s+'), lambda x: x <> '') AS w FROM prompt_table), v AS (SELECT * FROM w WHERE len(w) > 0)"
_IDLE = "SELECT seg_id, coalesce(action_keys, 'None') AS keys, {} AS mouse FROM action_segments"

QUERIES = {
    "whitespace_clean": (whitespace_clean, f"SELECT prompt_id, trim(regexp_replace(prompt, '{captions.WHITE}+', ' ', 'g')) AS text FROM prompt_table"),
    "html_clean": (html_clean, None),
    "html_escape": (html_escape, "SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM documents"),
    "strip_camera_motion": (strip_camera_motion, None),
    "camera_segments": (camera_segments, None),
    "action_resolution": (action_resolution, None),
    "json_list_or_struct": (json_list_or_struct, """
WITH j AS (SELECT prompt_id, CASE WHEN json_valid(chunk_actions_json) THEN from_json(chunk_actions_json, '[{"keys": "VARCHAR", "mouse": "VARCHAR"}]') END AS a FROM prompt_table WHERE chunk_actions_json IS NOT NULL)
SELECT prompt_id, array_to_string(list_transform(a, lambda x: coalesce(x.keys, 'None') || '/' || coalesce(x.mouse, '·')), ',') AS actions FROM j"""),
    "dirname_parse": (dirname_parse, "SELECT seg_id, coalesce(action_keys, NULL) AS keys, CASE WHEN action_keys IS NULL THEN NULL WHEN action_mouse IN ('↑', '↓', '←', '→', '↑←', '↑→', '↓←', '↓→') THEN action_mouse ELSE '·' END AS mouse FROM action_segments"),
    "action_text_lines": (action_text_lines, "SELECT seg_id, coalesce(action_keys, action_mouse, 'None') AS keys, CASE WHEN action_keys IS NULL THEN '·' ELSE coalesce(action_mouse, '·') END AS mouse FROM action_segments"),
    "even_distribution": (even_distribution, _W + """
SELECT prompt_id, array_to_string(flatten(list_transform(w, lambda x, i: list_transform(range(0, (len(w) + 5) // len(w) + CASE WHEN i <= (len(w) + 5) % len(w) THEN 1 ELSE 0 END), lambda k: x))), ' ') AS words,
  array_to_string(flatten(list_transform(w, lambda x, i: list_transform(range(0, 9 // len(w) + CASE WHEN i <= 9 % len(w) THEN 1 ELSE 0 END), lambda k: x))), ' ') AS over_9 FROM v"""),
    "pad_truncate": (pad_truncate, _W + " SELECT prompt_id, array_to_string(list_transform(range(1, 61), lambda i: w[least(i, len(w))]), ' ') AS words, w[least(100, len(w))] AS beyond FROM v"),
    "ordered_prompt_list": (ordered_prompt_list, """
SELECT id, md5(array_to_string(list(coalesce(refined_prompt, prompt, '') ORDER BY prompt_id), '|')) AS digest, CAST(count(*) AS INTEGER) AS n, arg_min_null(action_keys, prompt_id) AS keys, arg_min_null(action_mouse, prompt_id) AS mouse FROM prompt_table WHERE id IS NOT NULL GROUP BY 1"""),
    "prompt_normalize": (prompt_normalize, "SELECT id, CASE WHEN id IS NULL THEN '' ELSE id || '.jpg' END AS image_name, md5(coalesce(prompt, '')) AS digest FROM prompt_table"),
    "label_records": (label_records, "SELECT prompt_id, coalesce(nullif(refined_prompt, ''), prompt) AS text, coalesce(nullif(action_class, ''), 'scene') AS action_class FROM prompt_table"),
    "url_stem_ext": (url_stem_ext, rf"SELECT clip_id, {_STEM} AS stem, regexp_extract(path, '(\.[^./]+)$', 1) AS extension FROM toy_filter"),
    "title_case_alias": (title_case_alias, f"""
WITH n(name, metric) AS ({dims.sql_values([*dims.ALIASES.items(), ("other_metric", "other_metric")])}) SELECT name, metric, array_to_string(list_transform(string_split(metric, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM n"""),
    "prefix_rename": (prefix_rename, "SELECT clip_id, CASE WHEN starts_with(path, 'videos_clip_v1/') THEN 'v1:' || substr(path, 16) WHEN starts_with(path, './videos/') THEN 'here:' || substr(path, 10) WHEN starts_with(path, 'videos/') THEN 'v:' || substr(path, 8) ELSE path END AS renamed FROM toy_filter"),
    "template_base64": (template_base64, "SELECT clip_id, replace('Rate these ##NUM_FRAMES## frames.', '##NUM_FRAMES##', CAST(num_frames AS VARCHAR)) AS text, base64(encode(path)) AS encoded FROM toy_filter"),
    "id_token_prompt": (id_token_prompt, "SELECT id, '<clip> ' || prompt AS prompt FROM eval_prompt"),
}
