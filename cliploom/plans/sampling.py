"""Queries on sampling, sharding and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions.captions import WHITE
from cliploom.operators import sampling, windows
from cliploom.session import table

RATIOS = {"en": 3.0, "fr": 1.0, "de": 1.0, "zh": 2.0, "ru": 0.5}


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "latent_sample").withColumn("bucket", F.concat_ws("x", "height", "width"))


def rank_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shard(table(spark, sf_dir, "prompt_table").select("prompt_id"), [F.col("prompt_id")], 3, 8)


def padded_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sampling.padded_shards(table(spark, sf_dir, "eval_prompt").select("id"), [sampling.shuffle_key(F.col("id"), 5), F.col("id")], 7)
    return d.select("id", "rank", "place")


def dropped_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sampling.padded_shards(table(spark, sf_dir, "eval_prompt").select("id"), [sampling.shuffle_key(F.col("id"), 5), F.col("id")], 7, drop_last=True)
    return d.select("id", "rank", "place")


def ratio_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sampling.ratio_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", RATIOS, 1500, 11)
    return d.select("doc_id", "lang", F.col("copy").cast("int").alias("copy"))


def equal_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.equal_sample(table(spark, sf_dir, "eval_prompt").select("id", "split"), "split", "id", 4).select("id", "split")


def bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batches(_samples(spark, sf_dir).select("sample_id", "bucket"), "bucket", "sample_id", 16, 9).select("sample_id", "bucket", "batch", "batch_key")


def batch_count_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    kept = sampling.batch_counts(s, "bucket", 16, 4, False).withColumnRenamed("batches", "batches_all")
    return kept.join(sampling.batch_counts(s, "bucket", 16, 4, True).drop("samples"), "bucket")


def chunk_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "toy_filter").filter("num_frames > 0").withColumn("sections", windows.sections(F.col("num_frames")))
    return c.select("clip_id", sampling.pick(F.col("clip_id"), 1000003, F.col("sections")).alias("chunk"))


def caption_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = sampling.without_caption(F.col("v"), F.col("vec_id"), 0.1, 3)
    return v.select("vec_id", F.forall(out, lambda x: x == 0).alias("dropped"))


def distinct_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.distinct_prompts(table(spark, sf_dir, "prompt_table"), "prompt", 200, 2)


def section_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "toy_filter").filter("num_frames > 0").withColumn("sections", windows.sections(F.col("num_frames")))
    s = sampling.section_choice(F.col("sections"), F.least(F.lit(3), F.col("sections")), F.col("clip_id"), 8)
    return c.select("clip_id", F.array_join(s, ",").alias("chosen"))


_K = "md5({} || ':{}:0')"
_DEAL = f"WITH p AS (SELECT id, row_number() OVER (ORDER BY {_K.format('id', 5)}, id) - 1 AS place, count(*) OVER () AS n FROM eval_prompt)"
_SEC = "WITH c AS (SELECT clip_id, CAST(greatest(1, ceil(num_frames / 33)) AS INTEGER) AS s FROM toy_filter WHERE num_frames > 0)"
_TARGETS = {g: max(1, int(1500 * r / sum(RATIOS.values()))) for g, r in RATIOS.items()}

_WHITE = WHITE  # the same class in SQL

QUERIES = {
    "rank_stride": (rank_stride, "SELECT prompt_id FROM (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS p FROM prompt_table) WHERE p % 8 = 3"),
    "padded_shards": (padded_shards, _DEAL + ", a AS (SELECT id, place FROM p UNION ALL SELECT id, place + n FROM p WHERE place < (7 - n % 7) % 7) SELECT id, CAST(place % 7 AS INTEGER) AS rank, place FROM a"),
    "dropped_shards": (dropped_shards, _DEAL + " SELECT id, CAST(place % 7 AS INTEGER) AS rank, place FROM p WHERE place < n - n % 7"),
    "ratio_sample": (ratio_sample, f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_K.format('doc_id', 11)}, doc_id) - 1 AS rk, count(*) OVER (PARTITION BY lang) AS n FROM documents),
t AS (SELECT *, CASE lang {' '.join(f"WHEN '{g}' THEN {n}" for g, n in _TARGETS.items())} ELSE n END AS t FROM r)
SELECT doc_id, lang, CAST(unnest(range(1, CAST(ceil((t - rk) / n) AS BIGINT) + 1)) AS INTEGER) AS copy FROM t WHERE t > rk"""),
    "equal_sample": (equal_sample, f"""
WITH r AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY {_K.format('id', 4)}, id) AS rk FROM eval_prompt), n AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM eval_prompt GROUP BY split))
SELECT id, split FROM r, n WHERE rk <= m"""),
    "bucket_batches": (bucket_batches, f"""
WITH r AS (SELECT sample_id, concat_ws('x', height, width) AS bucket FROM latent_sample), s AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_K.format('sample_id', 9)}, sample_id) - 1 AS rk, count(*) OVER (PARTITION BY bucket) AS n FROM r)
SELECT sample_id, bucket, rk // 16 AS batch, {_K.format("(bucket || '/' || (rk // 16))", 9)} AS batch_key FROM s WHERE rk // 16 < n // 16"""),
    "batch_count_math": (batch_count_math, """
SELECT concat_ws('x', height, width) AS bucket, count(*) AS samples, CAST(ceil(ceil(count(*) / 4) / 16) AS BIGINT) AS batches_all, CAST(floor(floor(count(*) / 4) / 16) AS BIGINT) AS batches FROM latent_sample GROUP BY 1"""),
    "chunk_pick": (chunk_pick, _SEC + f" SELECT clip_id, CAST(('0x' || left({_K.format('clip_id', 1000003)}, 8)) AS BIGINT) % s AS chunk FROM c"),
    "caption_dropout": (caption_dropout, f"SELECT vec_id, CAST(('0x' || left({_K.format('vec_id', 3)}, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.1::DOUBLE OR list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') = 0 AS dropped FROM embeddings"),
    "distinct_prompts": (distinct_prompts, f"SELECT prompt FROM (SELECT DISTINCT regexp_replace(prompt, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS prompt FROM prompt_table) WHERE prompt <> '' ORDER BY {_K.format('prompt', 2)}, prompt LIMIT 200"),
    "section_choice": (section_choice, _SEC + f""", e AS (SELECT clip_id, s, unnest(range(0, s)) AS k FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY {_K.format("(clip_id || '/' || k)", 8)}, k) AS rk FROM e)
SELECT clip_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS chosen FROM r WHERE rk <= least(3, s) GROUP BY clip_id"""),
}
