"""Problem 4: groups of rows whose captions share most of their content.

Method: one-permutation hashing with optimal densification over runs of ten letters and digits, banded buckets, and
star-shaped candidate edges: a bucket links its members to one centre, so its pairs grow with its size and not with the
square of it. Candidates pass a 256-bit sketch and then the exact comparison. A member that a centre turned away may
still belong to another member of the bucket, so once the centres' edges have made groups, members of buckets that are
still in different groups are compared too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.candidates import band_parts, band_rows, checked, confirmed, in_pieces, likely, numbered, sketch_rows, sketched_pairs, star_pairs
from cliploom.llm.components import components
from cliploom.llm.ledger import members_of
from cliploom.llm.shingles import RUN, Plan, plan_for
from cliploom.llm.text_keys import caption_set, digest
from cliploom.session import drop_path, fresh_path, release_shuffles, spread, table

THRESHOLD = 0.5


class Work:
    """Tables of one run in the shared folder; those no longer needed are removed as the run goes on."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, fresh_path(spark, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, f"{self.root}/{name}")
        release_shuffles(self.spark)


def entries_of(df: DataFrame, tbl: str, id_col: str, captions: Column) -> DataFrame:
    """(tbl, id, first, pos, digest, key): one row per distinct caption of a row that has runs to compare.

    ``first`` stands for the row: the digest of its first such caption, or of its whole set where no caption is long
    enough to have a run (such rows only match rows that are the same). Rows with nothing to compare and null ids fall out.
    """
    rows = df.select(F.lit(tbl).alias("tbl"), df[id_col].cast("bigint").alias("id"), caption_set(captions).alias("_all"))
    rows = rows.filter((F.size("_all") > 0) & F.col("id").isNotNull()).withColumn("_long", F.filter("_all", lambda k: F.length(k) >= RUN))
    whole = digest(F.concat(F.lit("set:"), F.concat_ws(" ", "_all")))
    first = F.when(F.size("_long") > 0, digest(F.get("_long", F.lit(0)))).otherwise(whole)
    out = rows.select("tbl", "id", first.alias("first"), F.posexplode_outer("_long").alias("pos", "key"))
    return out.withColumn("digest", digest(F.col("key")))


def similar_groups(entries: DataFrame, threshold: float = THRESHOLD, run: int = RUN, plan: Plan | None = None, screen: bool = True) -> DataFrame:
    """(tbl, keep_id, dup_id) of the groups of rows connected by captions at least ``threshold`` similar, per tbl.

    ``entries`` as ``entries_of`` makes them. Copies are collapsed before anything is compared. A row's captions belong
    together, so a row with several of them can connect their groups. Without ``screen`` no candidate is turned away by its
    sketch; with that and the plan ``NEARLY_EXACT`` the result is an exact comparison's but for odds of 10^-9 a pair.
    """
    spark = entries.sparkSession
    work = Work(spark, "neardup")
    entries = work.put(entries, "entries")
    keyed = work.put(entries.filter("pos is null or pos = 0").select("tbl", "id", F.col("first").alias("key")), "keyed")
    together = work.put(entries.filter("pos > 0").select("tbl", "first", "digest").distinct(), "together")
    distinct = entries.filter("key is not null").groupBy("tbl", "digest").agg(F.first("key").alias("key"))
    texts = work.put(numbered(distinct), "texts")
    work.drop("entries")

    total, rows = texts.count(), keyed.count()
    plan = plan or plan_for(total)
    # Texts of different tables never meet: each table has buckets of its own, named by its number above band and hash.
    tables = [r.tbl for r in texts.select("tbl").distinct().collect()]  # one entry per table
    raw = [star_pairs(band_rows(texts.filter(F.col("tbl") == t), plan, total, run, split_hot=True), band_parts(total) > 1).withColumn("bucket", F.col("bucket") + F.lit(i << 48)) for i, t in enumerate(tables)]
    raw = work.put(reduce(DataFrame.unionByName, raw), "raw") if raw else spark.createDataFrame([], "a bigint, b bigint, bucket bigint")
    release_shuffles(spark)

    sketch = work.put(sketch_rows(texts, run), "sketch")
    probable = work.put(likely(raw.select("a", "b").distinct(), sketch, sketch, threshold, screen), "probable")
    rest = work.put(raw.filter("bucket is not null").select("bucket", F.explode(F.array("a", "b")).alias("uid")).distinct(), "rest")
    work.drop("raw")
    # Texts that any pair needs, each with its best edge and what else it is needed for, so that a check moves no others.
    centres = probable.select(F.col("a").alias("uid"), F.lit(1).alias("centre"), F.lit(0).alias("edges"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("agree"), F.lit(0).alias("rest"))
    members = probable.select(F.col("b").alias("uid"), F.lit(0).alias("centre"), F.lit(1).alias("edges"), "a", F.col("agree").cast("bigint").alias("agree"), F.lit(0).alias("rest"))
    others = rest.select("uid", F.lit(0).alias("centre"), F.lit(0).alias("edges"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("agree"), F.lit(1).alias("rest"))
    best = F.max(F.when(F.col("agree").isNotNull(), F.struct("agree", "a"))).getField("a")
    involved = centres.unionByName(members).unionByName(others).groupBy("uid").agg(F.max("centre").alias("centre"), F.sum("edges").alias("edges"), best.alias("best"), F.max("rest").alias("rest"))
    some = work.put(texts.select("uid", "key").join(involved, "uid"), "some")
    release_shuffles(spark)

    by_digest = texts.select("tbl", "digest", "uid")
    same_row = together.join(by_digest, ["tbl", "digest"]).select("tbl", "first", F.col("uid").alias("b"))
    same_row = work.put(same_row.join(by_digest.withColumnRenamed("digest", "first"), ["tbl", "first"]).select(F.col("uid").alias("a"), "b"), "same_row")

    # First each member's best edge: a forest that joins up large groups, after which most of their other edges are settled.
    hub = some.filter("centre = 1").select("uid", "key")
    branches = some.filter("best is not null").select(F.col("best").alias("a"), F.col("uid").alias("b"), F.col("key").alias("kb"))
    forest = branches.select("a", "b")
    with_hub = branches.join(hub.select(F.col("uid").alias("a"), F.col("key").alias("ka")), "a")
    edges = [same_row, work.put(checked(with_hub, threshold, run), "edges0")]
    labels = work.put(components(reduce(DataFrame.unionByName, edges)), "labels0")
    open_ = _apart(probable.select("a", "b"), labels).join(forest, ["a", "b"], "left_anti")
    edges.append(work.put(confirmed(open_, hub, some.filter("edges > 1"), threshold, run), "edges1"))
    labels = work.put(components(reduce(DataFrame.unionByName, edges)), "labels1")

    missed = _pairs_besides_centre(work, rest, labels, sketch, threshold, screen)
    in_rest = some.filter("rest = 1")
    edges.append(work.put(confirmed(missed, in_rest, in_rest, threshold, run), "edges2"))
    if not edges[-1].isEmpty():
        labels = work.put(components(reduce(DataFrame.unionByName, edges)), "labels2")

    # Back to rows: each text's group, each row by its first caption.
    group = texts.join(labels, "uid").select("tbl", F.col("digest").alias("key"), F.col("comp"))
    least = keyed.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    placed = work.put(least.join(group, ["tbl", "key"], "left"), "placed")
    heads = placed.filter("comp is not null").groupBy("tbl", "comp").agg(F.min("least").alias("keep_id"), F.sum("copies").alias("members"))
    single = placed.filter("comp is null").select("tbl", "key", "copies", F.col("least").alias("keep_id"), F.col("copies").alias("members"))
    joined = placed.filter("comp is not null").join(heads, ["tbl", "comp"]).select("tbl", "key", "copies", "keep_id", "members")
    return members_of(keyed, single.unionByName(joined), rows, members="members")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one group yet."""
    to = lambda c: labels.select(F.col("uid").alias(c), F.col("comp").alias("_" + c))
    both = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left")
    return both.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _pairs_besides_centre(work: Work, rest: DataFrame, labels: DataFrame, sketch: DataFrame, threshold: float, screen: bool) -> DataFrame:
    """Likely pairs (a, b) of bucket members that are in different groups and of which neither is the bucket's centre.

    Each such pair has a member outside the centre's group, so only these are set against the bucket; the sketches decide
    inside the join and only likely pairs leave it. Members of one group are never paired. A large bucket meets in pieces.
    """
    placed = rest.join(labels, "uid", "left").select("bucket", "uid", F.coalesce("comp", "uid").alias("comp"))
    info = placed.groupBy("bucket").agg(F.min("uid").alias("centre"), F.min_by("comp", "uid").alias("home"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"))
    held = placed.join(info.filter("lo <> hi").drop("lo", "hi"), "bucket").filter("uid <> centre").join(sketch, "uid").drop("centre")
    held = work.put(held, "held")
    pairs = sketched_pairs(*in_pieces(held.filter("comp <> home"), held, "bucket", "members"), threshold, "place", "comp", screen)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def caption_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = spread(table(spark, sf_dir, "toy_filter").select("clip_id", "cap"))
    prompts = spread(table(spark, sf_dir, "prompt_table").select("prompt_id", "prompt"))
    return entries_of(clips, "toy_filter", "clip_id", clips["cap"]).unionByName(entries_of(prompts, "prompt_table", "prompt_id", F.array(prompts["prompt"])))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of toy_filter and of prompt_table in groups of similar text: the smallest key and each other member."""
    return similar_groups(caption_entries(spark, sf_dir))


SQL = {
    "p4_found": r"""
WITH RECURSIVE sets AS (
  SELECT 'toy_filter' AS tbl, clip_id AS id, list_sort(list_distinct(list_filter(list_transform(cap, lambda c: lower(regexp_replace(c, '[^\p{L}\p{N}]+', '', 'g'))), lambda k: k <> ''))) AS s FROM toy_filter
  UNION ALL SELECT 'prompt_table', prompt_id, list_filter([lower(regexp_replace(prompt, '[^\p{L}\p{N}]+', '', 'g'))], lambda k: k <> '') FROM prompt_table),
held AS (SELECT * FROM sets WHERE len(s) > 0),
entry AS (SELECT tbl, id, unnest(s) AS k FROM held),
texts AS (SELECT tbl, k, row_number() OVER () AS t FROM (SELECT DISTINCT tbl, k FROM entry WHERE length(k) >= 10)),
runs AS (SELECT tbl, t, len(g) AS n, unnest(g) AS g FROM (SELECT tbl, t, list_distinct(list_transform(range(1, length(k) - 8), lambda i: substr(k, i, 10))) AS g FROM texts)),
shared AS (SELECT a.t AS a, b.t AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS common FROM runs a JOIN runs b ON a.g = b.g AND a.tbl = b.tbl AND a.t < b.t GROUP BY 1, 2),
near AS (SELECT a, b FROM shared WHERE 2 * common >= an + bn - common UNION ALL SELECT t, t FROM texts),
place AS (SELECT tbl, id, t FROM entry JOIN texts USING (tbl, k)),
first_of AS (SELECT t, min(id) AS id FROM place GROUP BY 1),
link AS (
  SELECT p.tbl, p.id AS x, f.id AS y FROM place p JOIN first_of f USING (t)
  UNION SELECT x.tbl, fx.id, fy.id FROM near JOIN texts x ON x.t = a JOIN first_of fx ON fx.t = a JOIN first_of fy ON fy.t = b
  UNION SELECT tbl, id, min(id) OVER (PARTITION BY tbl, s) FROM held),
both_ways AS (SELECT tbl, x, y FROM link WHERE x <> y UNION SELECT tbl, y, x FROM link WHERE x <> y),
reached AS (SELECT DISTINCT tbl, x AS id, x AS other FROM both_ways UNION SELECT r.tbl, r.id, w.y FROM reached r JOIN both_ways w ON w.tbl = r.tbl AND w.x = r.other)
SELECT tbl, min(other) AS keep_id, id AS dup_id FROM reached GROUP BY tbl, id HAVING min(other) <> id""",
}
