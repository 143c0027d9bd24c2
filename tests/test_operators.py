"""Joins, sampling, state, streams, readers and writers on small inputs."""

import json
import os
import random
import subprocess
import sys
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cliploom.functions import dims
from cliploom.functions.captions import strip_camera_motion, stripped
from cliploom.operators import collate, compare, joins, ordering, sampling, state, windows
from cliploom.session import fresh_path
from cliploom.sources import manifests, prompts, results, sinks
from cliploom.streaming import state as streams


def test_chunk_labels_equal_brute_force(spark):
    rng = random.Random(1)
    segments = []
    for i in range(300):
        a = rng.randrange(0, 500)
        segments.append((i, f"v{rng.randrange(6)}", a, a + rng.randrange(0, 120), rng.choice(dims.KEYS), rng.choice(dims.MOUSE)))
    segments += [(900, None, 0, 9, "W", "·"), (901, "v1", None, 9, "W", "·"), (902, "v1", 90, 20, "W", "·"), (903, "v9", 16, 16, "A", "↑")]
    videos = [(f"v{i}", 14) for i in range(8)] + [("v9", 2), ("none", 0)]
    got = joins.chunk_labels(spark.createDataFrame(videos, "video string, chunks bigint"), spark.createDataFrame(segments, "seg_id bigint, video string, start_frame int, end_frame int, action_keys string, action_mouse string"))
    expected = set()
    for v, n in videos:
        for c in range(n):
            held = [s for s in segments if s[1] == v and s[2] is not None and s[2] <= 33 * c + 16 <= s[3]]
            best = min(held, key=lambda s: (s[2], s[0]), default=(0, 0, 0, 0, *dims.IDLE))
            expected.add((v, c, best[4], best[5]))
    assert {tuple(r) for r in got.collect()} == expected


def test_positions(spark):
    rng = random.Random(2)
    values = [rng.randrange(1000) for _ in range(5000)]
    got = ordering.positions(spark.createDataFrame(list(enumerate(values)), "id bigint, v int"), [F.col("v"), F.col("id")]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(5000)) and [(r.v, r.id) for r in got] == sorted((v, i) for i, v in enumerate(values))


def test_unique_or_fail(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.unique_or_fail(df, "k", "twice").count() == 2
    with pytest.raises(PySparkException, match="twice"):
        joins.unique_or_fail(df.union(df), "k", "twice").collect()


def test_nearest_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(5.0,), (-3.0,), (100.0,), (None,)], "v double")
    assert [r.n and r.n.place for r in df.select(joins.nearest(F.col("v"), [0.0, 10.0, 10.0]).alias("n")).collect()] == [0, 0, 1, None]


def test_full_resolution_path(spark):
    df = spark.createDataFrame([("r/mid/a_81_192_320.pt",), ("r/low/a_81_96_160.pt",), ("r/a_81_384_640.pt",), (None,)], "p string")
    got = [r.x for r in df.select(joins.full_resolution_path(F.col("p"), F.lit(384), F.lit(640)).alias("x")).collect()]
    assert got == ["r/a_81_384_640.pt"] * 3 + [None]


def test_ratio_sample_counts(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, "a").when(F.col("id") < 990, "b").when(F.col("id") < 995, "c").alias("g"))
    got = sampling.ratio_sample(df, "g", "id", {"a": 1.0, "b": 1.0}, 400, 1)
    counts = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert counts == {"a": 200, "b": 200, "c": 5, None: 5}
    uses = [r["count"] for r in got.filter("g = 'b'").groupBy("id").count().collect()]
    assert max(uses) - min(uses) <= 1 and len(uses) == 90


def test_tolerant_union(spark):
    a = spark.createDataFrame([(1.0,), (2.0,)], "t double")
    b = spark.createDataFrame([(1.00005,), (1.5,), (1.9998,), (2.5,)], "t double")
    assert sorted(r.t for r in compare.tolerant_union(a, b, "t", 1e-4).collect()) == [1.0, 1.5, 1.9998, 2.0, 2.5]


def test_config_differences(spark):
    schema = "path string, value string"
    a = spark.createDataFrame(compare.flattened({"m": {"x": 1, "y": [1, 2], "z": None}, "only": 1, "path": {"out": "a"}}), schema)
    b = spark.createDataFrame(compare.flattened({"m": {"x": 2, "y": [2, 1], "z": None}, "new": 3, "path": {"out": "b"}}), schema)
    diff = compare.differences(a, b)
    assert {(r.path, r.kind) for r in compare.without_ignored(diff, ["out", "m.y"]).collect()} == {("m.x", "differs"), ("only", "only left"), ("new", "only right")}
    with pytest.raises(PySparkException, match="config"):
        compare.drift_or_fail(diff, "config").collect()
    assert compare.drift_or_fail(compare.differences(a, a), "config").count() == 0


@pytest.mark.parametrize("partitions, batch", [(1, 10_000), (5, 7), (16, 3)])
def test_moving_average_over_many_tasks(spark, partitions, batch):
    """A key's rows in one range or many, in one batch or many, give the fold of the whole sequence."""
    rng = random.Random(3)
    rows = [(k, i, rng.random()) for k in ("a", "b") for i in range(157)] + [("c", 0, 5.0), ("d", 0, None), ("b", 9000, None)]
    df = spark.createDataFrame(rows, "k string, o bigint, v double")
    expected = {}
    for k in ("a", "b", "c"):
        g = None
        for _, o, v in (r for r in rows if r[0] == k and r[2] is not None):
            g = v if g is None else 0.8 * g + 0.2 * v
            expected[k, o] = g
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {(r.k, r.o): r.ema for r in state.moving_average(df, "k", "o", "v", 0.8).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.keys() == expected.keys() and all(abs(got[x] - expected[x]) < 1e-9 for x in got)
    assert state.moving_average(df.limit(0), "k", "o", "v", 0.8).count() == 0


def test_similarity_buffer(spark):
    rows = [("a", i, [float(x), 0.0]) for i, x in enumerate([0, 10, 20, 11, 1, 30, 19])] + [("b", 0, [1.0, 1.0]), ("b", 1, None)]
    got = {(r.k, r.slot): r.i for r in state.similarity_buffer(spark.createDataFrame(rows, "k string, i bigint, v array<double>"), "k", "i", "i", "v", 3).collect()}
    assert got == {("a", 0): 4, ("a", 1): 6, ("a", 2): 5, ("b", 0): 0}


def test_stream_buffer_over_two_runs(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, place bigint, ident bigint"
    spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 0, 9)], schema).coalesce(1).write.parquet(source)
    stream = lambda: streams.newest_buffer(spark.readStream.schema(schema).parquet(source), 3)
    first = {r.key: r.ids for r in streams.drained(stream(), out, "update").collect()}
    assert first == {"a": [2, 3, 4], "b": [9]}
    spark.createDataFrame([("a", 5, 50)], schema).coalesce(1).write.mode("append").parquet(source)
    assert {r.key: r.ids for r in streams.drained(stream(), out, "update").collect()} == {"a": [3, 4, 50]}


def test_manifest_reading(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"cut": [0, 81], "crop": [0, 832, 0, 480], "fps": 24.0, "num_frames": 81, "resolution": {"height": 480, "width": 832}, "cap": ["x"], "path": "videos/2_240_ori81.mp4"}, {"cut": None, "path": "videos/3.mp4"}]))
    rows = manifests.derived(manifests.read_manifest(spark, str(path))).orderBy("video_path").collect()
    assert rows[0].num_frame == 81 and rows[0].height == 480 and rows[0].uttid == "2_240_ori81_0-81" and rows[1].num_frame is None


def test_names(spark):
    df = spark.createDataFrame([("r/AJw3_a_201_384_640.pt",), ("r/bad.pt",), ("out/global_step12_final_step_validation_video_3_a_b.mp4",), ("out/checkpoint-7_9.mp4",), ("out/x5_8.mp4",), ("v/77_240_ori9.mp4",), ("Keys_S_A_Mouse_Up/v_frames_0-32.mp4",)], "path string")
    r = manifests.latent_names(df).first()
    assert (r.uttid, r.num_frames, r.file_height, r.file_width, r.root) == ("AJw3_a", 201, 384, 640, "r")
    v = manifests.validation_videos(df).first()
    assert (v.step, v.kind, v.idx, v.slug) == (12, "final_step_validation", 3, "a b")
    assert {(x.step, x.idx) for x in manifests.checkpoint_videos(df).collect()} >= {(7, 9), (5, 8)}
    assert manifests.evaluation_videos(df).first().video_id == 77
    a = manifests.action_files(df).first()
    assert (a.video, a.start_frame, a.end_frame, a.keys, a.mouse) == ("v", 0, 32, "S+A", "↑")


def test_prompt_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,prompt,image_name\n1,"x, y",1.png\n')
    (tmp_path / "b.tsv").write_text("action_class\tprompt\tvideo_name\nscene\tq\tdir/v2.mp4\n")
    (tmp_path / "c.csv").write_text("videoFile,caption,caption_original\nv3.mp4,c,o\n")
    rows = {r.id: r for r in prompts.read_tables(spark, ",".join(str(tmp_path / f) for f in ("a.csv", "b.tsv", "c.csv"))).collect()}
    assert rows["1"].prompt == "x, y" and rows["v2"].image_name == "v2.jpg" and rows["v3"].prompt_original == "o"
    with pytest.raises(ValueError, match="duration"):
        prompts.require_columns(spark.range(1), "id", "duration")
    assert prompts.video_column(spark.createDataFrame([("a",)], "video_name string")) == "video_name"
    (tmp_path / "p.txt").write_text("first\n\n third \n")
    assert sorted((r.line_no, r.prompt, r.uttid) for r in prompts.prompt_lines(spark, str(tmp_path / "p.txt"), True).collect()) == [(0, "first", "p_00000"), (2, "third", "p_00002")]
    assert sorted(r.line_no for r in prompts.prompt_lines(spark, str(tmp_path / "p.txt")).collect()) == [0, 1]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = {f: [f"{f} line {i}\u3000" if i % 3 else " \t" for i in range(n)] for f, n in (("a", 400), ("b", 1), ("c", 90))}
    for f, text in lines.items():
        (tmp_path / f"{f}.txt").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = spark.read.text(str(tmp_path))
        assert read.rdd.getNumPartitions() > 5
        for blanks in (True, False):
            got = sorted((r.uttid, r.prompt) for r in prompts.prompt_lines(spark, str(tmp_path), blanks).collect())
            numbered = [(f, i, t.strip()) for f, text in lines.items() for i, t in enumerate(x for x in text if blanks or x.strip())]
            assert got == sorted((f"{f}_{i:05d}", t) for f, i, t in numbered if t)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_white_space_of_all_kinds(spark):
    texts = ["A quiet harbour with boats at dusk and lanterns.\n", "\x85\u3000x\u2003", "\u00a0 \x1f", "a\u2028b", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", stripped(F.col("t")).alias("s"), strip_camera_motion(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.s for r in rows] == [None if t is None else t.strip() for t in texts] and rows[0].c == texts[0].strip()
    kept = sampling.distinct_prompts(spark.createDataFrame([("x",), ("x\t",), ("\u3000",), (None,)], "p string"), "p", None).collect()
    assert [r.prompt for r in kept] == ["x"]


def test_collate_and_merge(spark):
    rows = [(1, 1, 5, [1.0, 2.0], "a"), (1, 2, None, [3.0, 4.0], None), (1, 3, 7, [5.0, 6.0], "c"), (2, 4, 1, [1.0], None), (3, 5, 1, None, "x")]
    df = spark.createDataFrame(rows, "batch int, o int, n int, v array<double>, t string")
    item = F.when(F.col("t") != "c", F.struct("n", F.struct("t", "v").alias("in")))
    got = {r.batch: r for r in collate.collated(df.withColumn("item", item), "batch", "o", "item").collect()}
    assert set(got) == {1, 3} and got[1].n == [5] and got[1]["in"].t == ["a"] and got[3]["in"].v == [None]
    m = {r.batch: r for r in collate.merged(df, "batch", "o", ["n"], ["v"], ["t"]).collect()}
    assert m[1].n == [5, None, 7] and m[1].v == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and m[1].t == "a" and m[2].t is None
    s = {r.batch: r.s for r in df.groupBy("batch").agg(collate.in_order("o", "v").alias("a")).select("batch", collate.stacked(F.col("a")).alias("s")).collect()}
    assert (s[1].rows, s[1].width, s[1]["values"]) == (3, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) and s[3] is None


def test_rollout_fails_on_too_few_sections(spark):
    df = spark.createDataFrame([(1, 2)], "i int, n int")
    with pytest.raises(PySparkException, match="fewer"):
        df.select(windows.rollout_range(F.col("n"), 3, F.col("i")).alias("r")).collect()


def test_substitutes(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", None), (4, None, True), (5, None, False), (6, "a", True)], "i bigint, b string, ok boolean")
    used = {r.i: r.used for r in sampling.substituted(df, "i", "b", F.col("ok")).collect()}
    assert used[2] in (1, 6) and {i: used[i] for i in (1, 3, 4, 5, 6)} == {1: 1, 3: None, 4: 4, 5: 4, 6: 6}


def test_readers_pass_over_what_is_not_there(spark, tmp_path):
    with pytest.warns(UserWarning, match="no captions"):
        assert prompts.read_scene_captions(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "merged_results.json").write_text("{}")
    assert results.read_merged(spark, f"{tmp_path}/*/merged_results.json").count() == 0


def test_progress_of_streams(spark, sf):
    log = streams.Progress(5)
    spark.streams.addListener(log)
    try:
        out = streams.drained(streams.event_windows(streams.read_table(spark, sf, "events")), fresh_path(spark, "w"), "complete")
        for _ in range(50):
            if log.batches:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert out.count() and log.batches[0][2] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_stored_tables_go_with_the_process(tmp_path):
    code = (
        "from cliploom.session import local_session, materialize\n"
        "spark = local_session(1)\n"
        "print(materialize(spark.range(3), 'kept').inputFiles()[0])\n"
    )
    settings = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0], capture_output=True, text=True, env=settings)
    assert f"{tmp_path}/cliploom-" in done.stdout and not [f for f in os.listdir(tmp_path) if f.startswith("cliploom-")]


def test_results_and_sinks(spark, tmp_path):
    for model, metric, body in (("m1", "aesthetic_score", {"average_score": 0.7, "num_videos": 2}), ("m1", "drift_semantic_score", {"average_drift_score": 0.02, "num_videos": 2}), ("m2", "semantic", {"average_score": 0.0, "average_drift_score": 0.5})):
        (tmp_path / model).mkdir(exist_ok=True)
        (tmp_path / model / f"{metric}_results.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "m2" / "naturalness_results.json").write_text("{broken")
    docs = results.read_results(spark, f"{tmp_path}/*/*_results.json")
    assert docs.filter("unreadable").count() == 1
    facts = {(r.model, r.metric): r.average_score for r in results.metric_facts(docs).collect()}
    assert facts == {("m1", "aesthetic"): 0.7, ("m1", "drifting_semantic"): 0.02, ("m2", "semantic"): 0.0}
    assert {r.metric: r.average_score for r in results.metric_facts(docs, compat=True).filter("model = 'm2'").collect()} == {"semantic": 0.5}

    df = spark.createDataFrame([("u1", 81, 1, 2, "<a>"), ("u2", 81, 1, 2, None)], "uttid string, num_frame int, height int, width int, t string")
    out = fresh_path(spark, "samples")
    assert sinks.write_samples(df, out) == 2 and sinks.write_samples(df, out) == 0 and spark.read.parquet(out).count() == 2
    assert "&lt;a&gt;" in sinks.html_table(df, "t") and "u2" in sinks.statistics_report(df, "t")
    sinks.write_json_document(df, str(tmp_path / "d.json"))
    assert len(json.loads((tmp_path / "d.json").read_text())) == 2
    sinks.write_csv(df, str(tmp_path / "csv"), t=F.lit("no"), more=F.lit("yes"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns[-1] == "more" and {r.t for r in back.collect()} == {"<a>", None}


def test_latest_checkpoint(spark):
    df = spark.createDataFrame([("a", "checkpoint-9"), ("a", "checkpoint-100"), ("b", "checkpoint-5-final"), ("b", "checkpoint-900")], "run string, name string")
    assert {r.run: r.latest for r in windows.latest_checkpoint(df, "run", "name").collect()} == {"a": "checkpoint-100", "b": "checkpoint-5-final"}
