"""Problem 2: records of several sources mixed to target shares of a total size.

Method: weighted fair queueing. The records of a source are put in a shuffled order; a record's virtual finish time is the
size of its source up to and with it, all earlier passes over the source included, divided by the source's weight. All
records are sorted by finish time and taken until the total budget is reached. While every source has records left, each
thus holds its share of any prefix; a source that has been used ``max_repeats`` times is over, and the others go on in
proportion, which the reported shares show.

Running totals never gather a source or a mix in one task: rows fall into bins by the leading digits of their shuffle hash
or by finish time (along which, by construction, a mix is even), bins are totalled, and only rows of one bin are sorted
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.session import materialize, table

SEED = "mix-1"
#: Rows of one bin, about.
BIN_ROWS = 20_000


def root_of(name: Column, path: Column) -> Column:
    """The source: the given name, or else the folder of the file, without closing slashes and blanks."""
    given = F.nullif(F.trim(name), F.lit(""))
    return F.regexp_replace(F.coalesce(given, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)), r"/+$", "")


def usable_samples(samples: DataFrame) -> DataFrame:
    """(root, sample_id, size): each file once, by its smallest id, with its number of frames.

    A null or non-positive ``num_frame`` is read from the file name. Files without a size there too cannot be placed and
    null ids and paths cannot be named: they are left out.
    """
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    in_name = F.regexp_extract(name, r"_(\d{1,9})_\d+_\d+\.pt$", 1).try_cast("bigint")
    given = F.when(F.col("num_frame") > 0, F.col("num_frame").cast("bigint"))
    rows = samples.select(root_of(F.col("dataset_name"), F.col("file_path")).alias("root"), name.alias("file"), F.col("sample_id").cast("bigint").alias("sample_id"), F.coalesce(given, in_name).alias("size"))
    rows = rows.filter("sample_id is not null and file is not null and root is not null and size > 0")
    return rows.groupBy("root", "file").agg(F.min("sample_id").alias("sample_id"), F.max("size").alias("size")).drop("file")


def config_weights(configs: DataFrame) -> DataFrame:
    """(config_id, root, weight, max_repeats, epoch): one row per source of a mix. weight is null where the mix names no
    ratios; a null, negative or missing ratio of a source counts as 0, one listed twice has both its ratios."""
    listed = configs.filter("config_id is not null").select("config_id", F.col("dataset_sampling_ratios").alias("ratios"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"), F.col("epoch_frames").alias("epoch"), F.posexplode("instance_data_root").alias("pos", "name"))
    ratio = F.coalesce(F.get("ratios", F.col("pos")), F.lit(0.0))
    ratio = F.when(F.col("ratios").isNotNull(), F.when((ratio > 0) & ~F.isnan(ratio), ratio).otherwise(0.0))
    rows = listed.select("config_id", F.regexp_replace(F.trim("name"), r"/+$", "").alias("root"), ratio.alias("weight"), "max_repeats", "epoch").filter("root is not null")
    return rows.groupBy("config_id", "root").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("epoch").alias("epoch"))


def mix_plan(weights: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds to each source of a mix: its size ``available``, the ``budget``, its weight, target share and ``until``, a
    finish time by which the budget is reached, sources that run out before it taken into account."""
    plan = weights.join(totals, "root", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    mix = W.partitionBy("config_id")
    plan = plan.withColumn("budget", F.coalesce("epoch", F.sum("available").over(mix)))
    plan = plan.withColumn("weight", F.coalesce("weight", F.col("available").cast("double")))
    plan = plan.withColumn("target_share", F.try_divide("weight", F.sum("weight").over(mix)))
    active = (F.col("weight") > 0) & (F.col("available") > 0)
    cap = F.when(active, F.col("max_repeats") * F.col("available")).otherwise(0)
    plan = plan.withColumn("cap", cap).withColumn("over_at", F.when(active, F.col("cap") / F.col("weight")))
    order = mix.orderBy(F.col("over_at").asc_nulls_last(), "root")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.when(active, F.col("weight")).otherwise(0.0)).over(order.rowsBetween(0, W.unboundedFollowing))
    # Whole records finish up to one record of each source late, so the level is taken that much above the budget.
    largest = F.sum(F.when(active, F.col("largest")).otherwise(0)).over(mix)
    level = F.when(active, (F.col("budget") + largest - before) / left)
    # The first source in this order that lasts until the budget is reached tells when that is.
    plan = plan.withColumn("_level", level).withColumn("_turn", F.row_number().over(order))
    plan = plan.withColumn("_lasts", F.when(F.col("_level") <= F.col("over_at"), F.col("_turn")))
    until = F.coalesce(F.min_by("_level", "_lasts").over(mix), F.max("over_at").over(mix))
    return plan.withColumn("until", until).drop("_level", "_turn", "_lasts", "epoch", "cap", "over_at")


def hash_digits(rows: int) -> int:
    """Leading hexadecimal digits that cut ``rows`` into bins of about BIN_ROWS."""
    digits = 1
    while rows / 16**digits > BIN_ROWS:
        digits += 1
    return digits


def running(df: DataFrame, keys: list[str], bin_col: str, order: list, size: str, total: str, count: str | None = None) -> DataFrame:
    """Adds the running total of ``size`` (and the running count) within ``keys``, in order of ``bin_col``, then ``order``."""
    bins = df.groupBy(*keys, bin_col).agg(F.sum(size).alias("_s"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(bin_col).rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(*keys, bin_col, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    within = W.partitionBy(*keys, bin_col).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("_s", F.sum(size).over(within)).withColumn("_n", F.count(F.lit(1)).over(within)).join(bins, [*keys, bin_col])
    out = out.withColumn(total, F.col("_s0") + F.col("_s"))
    if count:
        out = out.withColumn(count, F.col("_n0") + F.col("_n"))
    return out.drop("_s", "_n", "_s0", "_n0")


def fair_mix(samples: DataFrame, weights: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The mixes, and their plan.

    samples: (root, sample_id, size); weights as ``config_weights`` gives them, one row per mix and source, so as many as
    the configurations list. Mix columns: config_id, position, sample_id, root, copy_no, size, finish. The running total of
    a mix stays within its budget; the first record that would pass it ends the mix.
    """
    samples = materialize(samples.withColumn("_h", F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f":{seed}")))), "samples")
    totals = samples.groupBy("root").agg(F.sum("size").alias("available"), F.count(F.lit(1)).alias("records"), F.max("size").alias("largest"))
    plan = materialize(mix_plan(weights, totals), "mix-plan")
    samples = samples.withColumn("_bin", F.substring("_h", 1, hash_digits(samples.count())))
    shuffled = running(samples, ["root"], "_bin", ["_h", "sample_id"], "size", "upto").drop("_bin", "_h")

    entries = plan.filter("weight > 0 and available > 0")
    per = entries.groupBy("config_id").agg(F.max(F.col("until") * F.lit(1 + 1e-9)).alias("_until"))
    entries = entries.join(per, "config_id")
    passes = F.ceil((F.col("_until") * F.col("weight") + F.col("size") - F.col("upto")) / F.col("available")).cast("int")
    used = shuffled.join(entries.drop("records", "largest", "target_share"), "root").withColumn("_copies", F.least(passes, "max_repeats")).filter("_copies > 0")
    placed = _copies(used)
    bins = F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(BIN_ROWS)))
    rows = entries.join(totals.select("root", F.col("records").alias("_r")), "root").groupBy("config_id").agg((F.max("budget") / F.sum("available") * F.sum("_r")).alias("_rows"))
    placed = placed.join(F.broadcast(rows), "config_id").withColumn("_bin", F.least(bins, F.floor(F.col("finish") / F.col("_until") * bins)).cast("bigint"))
    ordered = running(placed, ["config_id"], "_bin", ["finish", "root", "copy_no", "sample_id"], "size", "_total", "position")
    mix = ordered.filter("_total <= budget").select("config_id", "position", "sample_id", "root", "copy_no", "size", "finish")
    return mix, plan


def _copies(used: DataFrame) -> DataFrame:
    each = used.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    finish = ((F.col("copy_no") - 1) * F.col("available") + F.col("upto")) / F.col("weight")
    return each.select("config_id", "root", "sample_id", "size", "budget", "_until", "copy_no", finish.alias("finish"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fair_mix(usable_samples(table(spark, sf_dir, "latent_sample")), config_weights(table(spark, sf_dir, "data_config")))


def p2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every data_config mix in order."""
    mix, _ = _mix(spark, sf_dir)
    return mix.select("config_id", "position", "sample_id", "root", "copy_no", F.col("size").alias("num_frame"), F.round("finish", 3).alias("finish"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source of every mix, its frames, uses and different records."""
    mix, plan = _mix(spark, sf_dir)
    used = mix.groupBy("config_id", "root").agg(F.sum("size").alias("frames"), F.count(F.lit(1)).alias("uses"), F.countDistinct("sample_id").alias("records"), F.max("copy_no").alias("passes"))
    out = plan.select("config_id", "root", "target_share", "budget").join(used, ["config_id", "root"], "left").na.fill(0, ["frames", "uses", "records", "passes"])
    total = F.sum("frames").over(W.partitionBy("config_id"))
    return out.select("config_id", "root", "budget", F.round("target_share", 6).alias("target_share"), F.round(F.try_divide(F.col("frames"), total), 6).alias("actual_share"), "frames", "uses", "records", "passes")


_SQL_MIX = r"""
WITH named AS (
  SELECT regexp_replace(coalesce(nullif(trim(dataset_name), ''), regexp_extract(file_path, '^(.*)/[^/]*$', 1)), '/+$', '') AS root,
         regexp_extract(file_path, '([^/]*)$', 1) AS file, sample_id,
         coalesce(CASE WHEN num_frame > 0 THEN num_frame END, TRY_CAST(regexp_extract(file_path, '_([0-9]{1,9})_[0-9]+_[0-9]+\.pt$', 1) AS BIGINT)) AS size
  FROM latent_sample),
samples AS (SELECT root, min(sample_id) AS sample_id, max(size) AS size FROM named WHERE size > 0 GROUP BY root, file),
shuffled AS (
  SELECT *, sum(size) OVER (PARTITION BY root ORDER BY md5(sample_id || ':mix-1'), sample_id ROWS UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY root) AS available FROM samples),
totals AS (SELECT root, sum(size) AS available FROM samples GROUP BY root),
listed AS (
  SELECT config_id, max_repeats, epoch_frames, dataset_sampling_ratios AS ratios, unnest(instance_data_root) AS name, generate_subscripts(instance_data_root, 1) AS pos
  FROM data_config),
weights AS (
  SELECT config_id, regexp_replace(trim(name), '/+$', '') AS root, max(greatest(coalesce(max_repeats, 1), 1)) AS max_repeats, max(epoch_frames) AS epoch,
         sum(CASE WHEN ratios IS NOT NULL THEN CASE WHEN ratios[pos] > 0 THEN ratios[pos] ELSE 0.0 END END) AS weight
  FROM listed GROUP BY 1, 2),
plan AS (
  SELECT w.config_id, w.root, w.max_repeats, coalesce(t.available, 0) AS available, coalesce(w.weight, CAST(coalesce(t.available, 0) AS DOUBLE)) AS weight,
         coalesce(w.epoch, sum(coalesce(t.available, 0)) OVER (PARTITION BY w.config_id)) AS budget
  FROM weights w LEFT JOIN totals t USING (root)),
copies AS (
  SELECT p.config_id, s.root, s.sample_id, s.size, p.budget, c.copy_no, CAST((c.copy_no - 1) * s.available + s.upto AS DOUBLE) / p.weight AS finish
  FROM plan p JOIN shuffled s USING (root) JOIN range(1, 1000) c(copy_no) ON c.copy_no <= p.max_repeats WHERE p.weight > 0),
ordered AS (
  SELECT *, sum(size) OVER w AS total, row_number() OVER w AS position FROM copies
  WINDOW w AS (PARTITION BY config_id ORDER BY finish, root, copy_no, sample_id ROWS UNBOUNDED PRECEDING)),
mix AS (SELECT * FROM ordered WHERE total <= budget)
"""

SQL = {
    "p2_mix": _SQL_MIX
    + "SELECT config_id, position, sample_id, root, CAST(copy_no AS INTEGER) AS copy_no, CAST(size AS BIGINT) AS num_frame, round(finish, 3) AS finish FROM mix",
    "p2_shares": _SQL_MIX
    + """, used AS (
  SELECT config_id, root, sum(size) AS frames, count(*) AS uses, count(DISTINCT sample_id) AS records, max(copy_no) AS passes FROM mix GROUP BY 1, 2)
SELECT p.config_id, p.root, CAST(p.budget AS BIGINT) AS budget, round(p.weight / nullif(sum(p.weight) OVER (PARTITION BY p.config_id), 0), 6) AS target_share,
       round(coalesce(u.frames, 0) / nullif(sum(coalesce(u.frames, 0)) OVER (PARTITION BY p.config_id), 0), 6) AS actual_share,
       CAST(coalesce(u.frames, 0) AS BIGINT) AS frames, coalesce(u.uses, 0) AS uses, coalesce(u.records, 0) AS records, CAST(coalesce(u.passes, 0) AS INTEGER) AS passes
FROM plan p LEFT JOIN used u USING (config_id, root)""",
}
