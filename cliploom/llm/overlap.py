"""Problem 5: records of evaluation splits that also occur, exactly or almost, among the training captions.

Method: minwise hashes of the runs of ten letters and digits, banded buckets, only pairs of an evaluation and a training
text, exact Jaccard similarity of those that pass, and counts of the confirmed pairs by split and source. Copies of a text
are compared once; the pairs of rows are made at the end, from the pairs of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.candidates import band_rows, confirmed, cross_pairs, large_bucket_pairs, likely, numbered, sketch_rows
from cliploom.llm.neardup import THRESHOLD, Work
from cliploom.llm.shingles import RUN, Plan, plan_for
from cliploom.llm.text_keys import caption_key, caption_set, digest
from cliploom.session import release_shuffles, spread, table


def text_entries(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, key) of every row with a text long enough to have a run; others and null ids have no overlap."""
    rows = df.select(df[id_col].cast("bigint").alias("id"), caption_key(df[text_col]).alias("key"))
    return rows.filter((F.length("key") >= RUN) & F.col("id").isNotNull()).select("id", digest(F.col("key")).alias("digest"), "key")


def array_entries(df: DataFrame, id_col: str, entries_col: str) -> DataFrame:
    """The same for every distinct entry of an array of texts."""
    rows = df.select(df[id_col].cast("bigint").alias("id"), F.explode(caption_set(df[entries_col])).alias("key"))
    return rows.filter((F.length("key") >= RUN) & F.col("id").isNotNull()).select("id", digest(F.col("key")).alias("digest"), "key")


def overlapping_pairs(evaluation: DataFrame, training: DataFrame, threshold: float = THRESHOLD, run: int = RUN, plan: Plan | None = None, screen: bool = True) -> DataFrame:
    """(eval_id, train_id): each pair of rows with texts at least ``threshold`` similar, once.

    Both inputs are (id, digest, key). Equal texts are pairs too. Without ``screen`` no candidate is turned away by its sketch.
    """
    spark = evaluation.sparkSession
    work = Work(spark, "overlap")
    sides = []
    for name, side in (("eval", evaluation), ("train", training)):
        entries = work.put(side, name)
        texts = work.put(numbered(entries.groupBy("digest").agg(F.first("key").alias("key"))), f"{name}-texts")
        rows = work.put(entries.select("id", "digest"), f"{name}-rows")
        work.drop(name)
        sides.append((rows, texts))
    (eval_rows, eval_texts), (train_rows, train_texts) = sides
    total = max(eval_texts.count(), train_texts.count())
    plan = plan or plan_for(total)
    bands = band_rows(eval_texts, plan, total, run, 0).unionByName(band_rows(train_texts, plan, total, run, 1))
    raw = work.put(cross_pairs(bands), "raw")
    release_shuffles(spark)
    sketches = [sketch_rows(eval_texts, run), sketch_rows(train_texts, run)]
    large = not raw.filter("bucket is not null").isEmpty()
    if large:  # then the sketches are read twice
        sketches = [work.put(s, f"sketch{i}") for i, s in enumerate(sketches)]
    near = likely(raw.filter("bucket is null").select("a", "b").distinct(), *sketches, threshold, screen).select("a", "b")
    if large:
        near = near.unionByName(large_bucket_pairs(raw, *sketches, threshold, screen)).distinct()
    near = work.put(near, "near")
    work.drop("raw")
    found = work.put(confirmed(near, eval_texts, train_texts, threshold, run), "found")
    release_shuffles(spark)
    named = found.join(eval_texts.select(F.col("uid").alias("a"), F.col("digest").alias("ed")), "a").join(train_texts.select(F.col("uid").alias("b"), F.col("digest").alias("td")), "b")
    with_eval = named.select("ed", "td").join(eval_rows.select(F.col("digest").alias("ed"), F.col("id").alias("eval_id")), "ed")
    both = with_eval.select("eval_id", "td").join(train_rows.select(F.col("digest").alias("td"), F.col("id").alias("train_id")), "td")
    return both.select("eval_id", "train_id").distinct()


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = spread(table(spark, sf_dir, "eval_prompt").select("id", "prompt"))
    clips = spread(table(spark, sf_dir, "toy_filter").select("clip_id", "cap"))
    return overlapping_pairs(text_entries(prompts, "id", "prompt"), array_entries(clips, "clip_id", "cap"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of an eval_prompt row and a toy_filter row with similar texts."""
    return _pairs(spark, sf_dir).select(F.col("eval_id").alias("id"), F.col("train_id").alias("clip_id"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: its prompts, those that overlap with training captions, their pairs, and the share."""
    pairs = _pairs(spark, sf_dir).groupBy(F.col("eval_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    prompts = table(spark, sf_dir, "eval_prompt").select("id", "split", "source").join(pairs, "id", "left")
    out = prompts.groupBy("split", "source").agg(F.count(F.lit(1)).alias("prompts"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    return out.withColumn("share", F.round(F.col("overlapping") / F.col("prompts"), 6))


_PAIRS = r"""
WITH e AS (SELECT id, lower(regexp_replace(prompt, '[^\p{L}\p{N}]+', '', 'g')) AS k FROM eval_prompt),
t AS (SELECT DISTINCT clip_id, lower(regexp_replace(c, '[^\p{L}\p{N}]+', '', 'g')) AS k FROM (SELECT clip_id, unnest(cap) AS c FROM toy_filter)),
eg AS (SELECT k, list_distinct(list_transform(range(1, length(k) - 8), lambda i: substr(k, i, 10))) AS g FROM (SELECT DISTINCT k FROM e WHERE length(k) >= 10)),
tg AS (SELECT k, list_distinct(list_transform(range(1, length(k) - 8), lambda i: substr(k, i, 10))) AS g FROM (SELECT DISTINCT k FROM t WHERE length(k) >= 10)),
eu AS (SELECT k, len(g) AS n, unnest(g) AS g FROM eg), tu AS (SELECT k, len(g) AS n, unnest(g) AS g FROM tg),
shared AS (SELECT eu.k AS ek, tu.k AS tk, any_value(eu.n) AS en, any_value(tu.n) AS tn, count(*) AS common FROM eu JOIN tu ON eu.g = tu.g GROUP BY 1, 2),
pairs AS (SELECT DISTINCT e.id, t.clip_id FROM shared JOIN e ON e.k = ek JOIN t ON t.k = tk WHERE 2 * common >= en + tn - common)
"""

SQL = {
    "p5_found": _PAIRS + "SELECT * FROM pairs",
    "p5_report": _PAIRS
    + """, n AS (SELECT id, count(*) AS n FROM pairs GROUP BY 1)
SELECT split, source, count(*) AS prompts, count(n) AS overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs, round(count(n) / count(*), 6) AS share FROM eval_prompt LEFT JOIN n USING (id) GROUP BY 1, 2""",
}
