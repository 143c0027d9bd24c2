"""Mixing, coverage, and the queries on empty and unusual tables."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import coverage, mixing, queries
from tests.sql_compare import connect, same

SAMPLES = "sample_id bigint, uttid string, dataset_name string, file_path string, num_frame int, height int, width int, listed_at timestamp"
CONFIGS = "config_id bigint, config_name string, instance_data_root array<string>, dataset_sampling_ratios array<double>, max_repeats int, epoch_frames bigint"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same(spark, connect(sf), queries.queries()[name], queries.oracle_sql()[name], sf)


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_mix_holds_shares_and_limits(spark, tmp_path):
    rng = random.Random(1)
    rows, i = [], 0
    for root, n in (("d/big", 4000), ("d/mid/", 900), ("d/small", 60)):
        for _ in range(n):
            i += 1
            frames = rng.choice([33, 81, 201])
            rows.append((i, "u", root if i % 9 else None, f"{root.rstrip('/')}/u{i}_{frames}_384_640.pt", frames if i % 7 else None, 384, 640, None))
    rows += [(i + 1, "u", "d/big", rows[0][3], 33, 1, 1, None), (i + 2, "u", "d/big", "d/big/odd.pt", None, 1, 1, None), (None, None, None, None, None, None, None, None)]
    configs = [
        (1, "even", ["d/big", "d/mid", "d/small"], [1.0, 1.0, 1.0], 2, 60_000),
        (2, "natural", ["d/big/", "d/mid", "d/none"], None, 2, None),
        (3, "zero", ["d/big", "d/mid"], [1.0, 0.0], 1, 10_000),
        (4, "odd", ["d/big", "d/mid", "d/big"], [0.5, None, -1.0], None, 5_000),
        (5, "none", ["d/none"], [1.0], 3, None),
        (6, None, None, None, None, None),
        (7, "all", ["d/small"], [2.0], 3, 10**9),
    ]
    write(spark, tmp_path, latent_sample=(rows, SAMPLES), data_config=(configs, CONFIGS))
    folder = str(tmp_path)
    con = connect(folder)
    for name in ("p2_mix", "p2_shares"):
        same(spark, con, queries.queries()[name], queries.oracle_sql()[name], folder)
    shares = {(r.config_id, r.root): r for r in mixing.p2_shares(spark, folder).collect()}
    assert shares[1, "d/small"].passes == 2 and shares[1, "d/small"].uses == 120
    assert abs(shares[1, "d/big"].actual_share - shares[1, "d/mid"].actual_share) < 0.01
    assert shares[2, "d/big"].passes == 1 and shares[2, "d/none"].frames == 0
    assert shares[3, "d/mid"].frames == 0 and shares[3, "d/big"].frames <= 10_000
    assert shares[7, "d/small"].passes == 3 and shares[5, "d/none"].actual_share is None


def test_mix_is_the_same_in_small_bins(spark, sf, monkeypatch):
    whole = sorted(mixing.p2_mix(spark, sf).collect())
    monkeypatch.setattr(mixing, "BIN_ROWS", 7)
    assert sorted(mixing.p2_mix(spark, sf).collect()) == whole


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(2**bits), repeat=dims)))
    place = coverage.hilbert_index(points, bits)
    assert sorted(place) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def cells(spark, rows):
    return spark.createDataFrame(rows, "id bigint, penalty bigint, place bigint")


def test_subset_is_even_and_whole(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 3), rng.randrange(1 << 20) if i % 3 else 12345) for i in range(3000)]
    got = coverage.varied_subset(cells(spark, rows), 150, 20).collect()
    assert len(got) == 150 and len({r.id for r in got}) == 150 and len({r.cell for r in got}) == 150
    best = {}
    shift = 20 - (max(r.cell for r in got).bit_length() if got else 0)
    for i, p, place in rows:
        best[place >> shift] = min(best.get(place >> shift, (9, 0)), (p, i))
    assert sum(best[r.cell][1] == r.id for r in got if r.cell in best) >= 140


def test_subset_of_few_cells(spark):
    rows = [(i, 0, i % 5) for i in range(100)] + [(1, 0, 1)]
    got = coverage.varied_subset(cells(spark, rows), 23, 20).collect()
    per = sorted(sum(r.cell == c for r in got) for c in range(5))
    assert len(got) == len({r.id for r in got}) == 23 and per == [4, 4, 5, 5, 5]
    assert coverage.varied_subset(cells(spark, rows), 500, 20).count() == 100
    assert coverage.varied_subset(cells(spark, rows), 0, 20).count() == 0
    assert coverage.varied_subset(cells(spark, []), 10, 20).count() == 0


def brute_subset(rows, wanted, length):
    """The rule said plainly: the shortest prefix with enough cells, cells in order, rounds, an even choice in the last."""
    best = {}
    for i, p, place in rows:
        old = best.get(i, (p, place))
        best[i] = (min(p, old[0]), min(place, old[1]))
    if len(best) <= wanted:
        return {(i, place) for i, (_, place) in best.items()} if wanted > 0 else set()
    prefix = next((s for s in range(length) if len({pl >> (length - s) for _, pl in best.values()}) >= wanted), length)
    cells = {}
    for i, (p, place) in best.items():
        cells.setdefault(place >> (length - prefix), []).append((p, i))
    out, left, full = set(), wanted, 0
    while True:
        deep = sorted(c for c, held in cells.items() if len(held) > full)
        if len(deep) >= left:
            chosen = [c for r, c in enumerate(deep) if (r + 1) * left // len(deep) > r * left // len(deep)]
            return out | {(sorted(cells[c])[full][1], c) for c in chosen}
        out |= {(sorted(cells[c])[full][1], c) for c in deep}
        full, left = full + 1, left - len(deep)


@pytest.mark.parametrize("length", [9, 20, 30])
def test_subset_equals_the_plain_rule(spark, length):
    rng = random.Random(length)
    for n, hot, wanted in ((400, 0.0, 40), (400, 0.9, 60), (300, 0.99, 290), (300, 1.0, 7), (50, 0.5, 50), (60, 0.3, 1)):
        rows = [(rng.randrange(n * 2), rng.randint(0, 2), 3 if rng.random() < hot else rng.randrange(1 << length)) for _ in range(n)]
        got = coverage.varied_subset(cells(spark, rows), wanted, length).collect()
        assert {(r.id, r.cell) for r in got} == brute_subset(rows, wanted, length), (n, hot, wanted)


def test_a_dominant_cell_takes_few_jobs(spark):
    rows = [(i, 0, 5 if i >= 10 else i * 1000) for i in range(4000)]
    spark.sparkContext.setJobGroup("dominant", "subset")
    got = coverage.varied_subset(cells(spark, rows), 200, 20).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("dominant")
    spark.sparkContext.setJobGroup("", "")
    assert {(r.id, r.cell) for r in got} == brute_subset(rows, 200, 20) and len(jobs) < 40


def test_features_of_unusual_texts(spark):
    rows = [(1, ["a b c"], "x"), (2, ["C, b; A!"], "x"), (3, None, "x"), (4, ["", None, "..."], "x"), (None, ["a"], "x"), (5, ["word " * 50_000], "x"), (6, ["a b", "c"], "x")]
    f = {r.id: r for r in coverage.word_features(spark.createDataFrame(rows, "clip_id bigint, cap array<string>, f0 string"), "clip_id", "cap", F.lit(0)).collect()}
    assert set(f) == {1, 2, 5, 6} and f[1].f0 == f[2].f0 == f[6].f0


def test_subset_covers_more_than_chance(spark, sf):
    chosen = [r.clip_id for r in coverage.p3_subset(spark, sf).collect()]
    clips = spark.read.parquet(f"{sf}/toy_filter.parquet")
    assert len(chosen) == len(set(chosen)) == clips.count() // 20


def test_queries_on_empty_tables(spark, sf, tmp_path):
    for f in os.listdir(sf):
        spark.read.parquet(f"{sf}/{f}").limit(0).write.parquet(f"{tmp_path}/{f}")
    for name, query in queries.queries().items():
        full, empty = query(spark, sf), query(spark, str(tmp_path))
        assert empty.dtypes == full.dtypes and empty.count() == 0, name


def test_queries_on_null_tables(spark, sf, tmp_path):
    """Only the id columns are set."""
    for f in os.listdir(sf):
        df = spark.read.parquet(f"{sf}/{f}").limit(30)
        keep = {"clip_id", "prompt_id", "raw_id", "id", "doc_id", "config_id", "sample_id", "target_id"} if f not in ("prompt_table.parquet", "lang_sample.parquet") else {"prompt_id", "sample_id"}
        df.select(*(F.col(c) if c in keep and df.schema[c].dataType.simpleString() == "bigint" else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns)).write.parquet(f"{tmp_path}/{f}")
    sizes = {name: query(spark, str(tmp_path)).count() for name, query in queries.queries().items()}
    assert sizes.pop("p6_ids") == 30 and sizes.pop("p3_subset") == 0 and sizes.pop("p5_report") == 1
    assert not any(sizes.values()), sizes
