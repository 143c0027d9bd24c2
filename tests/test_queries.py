"""Every core query against its SQL, and the driver contract."""

import hashlib
import html
import json
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions import actions, captions, schedules
from cliploom.operators import leaderboard
from cliploom.plans import registry, scoring
from tests.sql_compare import connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf, name):
    same(spark, con, QUERIES[name], SQL[name], sf)


def rows_of(spark, sf, name, key):
    return {r[key]: r for r in QUERIES[name](spark, sf).collect()}


def test_queries_without_sql_have_a_test():
    """Those that SQL cannot say are compared with plain Python below."""
    assert set(QUERIES) - set(SQL) == {"merged_document", "similarity_buffer", "html_clean", "strip_camera_motion", "camera_segments", "action_resolution", "beta_draws", "frame_index_random"}


def prompts_of(spark, sf):
    return {r.prompt_id: r for r in spark.read.parquet(f"{sf}/prompt_table.parquet").collect()}


def test_merged_document(spark, sf):
    ratings = leaderboard.rated(leaderboard.metric_means(scoring._scores(spark, sf)))
    expected = {}
    for r in ratings.collect():
        part = "drifting" if r.metric.startswith("drifting_") else "non_drifting"
        expected.setdefault(r.model, {"drifting": {}, "non_drifting": {}})[part][r.metric] = (r.average_score, r.rating)
    totals = {r.model: r.total_rating for r in leaderboard.composite(ratings).collect()}
    got = {r.model: json.loads(r.document) for r in QUERIES["merged_document"](spark, sf).collect()}
    assert got.keys() == expected.keys() and len(got) == 5
    for model, doc in got.items():
        assert doc["total_rating"] == totals[model]
        assert {p: {m: (e["raw"], e["rating"]) for m, e in doc[p].items()} for p in ("drifting", "non_drifting")} == expected[model]


def test_similarity_buffer(spark, sf):
    held = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        ids, vectors = held.setdefault(r.label, ([], []))
        v = np.array(r.embedding, dtype=float)
        if len(ids) < 10:
            ids.append(r.vec_id)
            vectors.append(v)
        else:
            at = min(range(10), key=lambda i: (np.linalg.norm(vectors[i] - v), i))
            ids[at], vectors[at] = r.vec_id, v
    got = {(int(r.label), r.slot): r.vec_id for r in QUERIES["similarity_buffer"](spark, sf).collect()}
    assert got == {(label, i): x for label, (ids, _) in held.items() for i, x in enumerate(ids)}


def test_html_clean(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    clean = {i: None if t is None else " ".join(html.unescape(html.unescape(captions.repaired_text(t))).split()) for i, t in texts.items()}
    got = rows_of(spark, sf, "html_clean", "doc_id")
    assert {i: r.digest for i, r in got.items()} == {i: None if t is None else hashlib.md5(t.encode()).hexdigest() for i, t in clean.items()}


def test_strip_camera_motion(spark, sf):
    got, prompts = rows_of(spark, sf, "strip_camera_motion", "prompt_id"), prompts_of(spark, sf)
    assert got.keys() == prompts.keys()
    changed = 0
    for i, r in prompts.items():
        if r.prompt is None:
            assert got[i].text is None
        elif got[i].text != r.prompt:
            changed += 1
            assert len(got[i].text) >= 20 and got[i].text == got[i].text.strip() and not got[i].text[0].islower()
    assert changed


def test_camera_segments(spark, sf):
    got = rows_of(spark, sf, "camera_segments", "prompt_id")
    for i, r in prompts_of(spark, sf).items():
        assert json.loads(got[i].segments) == [list(a) for a in actions.camera_segments(r.prompt)]


def test_action_resolution(spark, sf):
    got = rows_of(spark, sf, "action_resolution", "prompt_id")
    sources = set()
    for i, r in prompts_of(spark, sf).items():
        try:
            own = json.loads(r.chunk_actions_json or "")
        except ValueError:
            own = None
        own = own if isinstance(own, list) and own else None
        acts = json.loads(got[i].actions)
        sources.add(got[i].source)
        assert len(acts) == 5
        if own:
            pairs = [[a.get("keys") or "None", a.get("mouse") or "·"] if isinstance(a, dict) else a for a in own]
            assert got[i].source == "chunk_actions_json" and acts == (pairs + [pairs[-1]] * 5)[:5]
        elif r.action_keys is not None and r.action_mouse is not None:
            assert got[i].source == "columns" and acts == [[r.action_keys, r.action_mouse]] * 5
        else:
            assert got[i].source in ("prompt", "prompt_original")
    assert len(sources) >= 3


def test_beta_draws(spark):
    ids = spark.range(20_000)
    for alpha, beta, step in ((4.0, 1.5, 0), (1.5, 4.0, 300), (4.0, 1.5, 1000)):
        a, b = schedules.annealed(alpha, step, 1000), schedules.annealed(beta, step, 1000)
        t = schedules.draw(F.col("id"), "beta", alpha, beta, step, 1000, "x")
        mean, variance = ids.agg(F.avg(t), F.var_pop(t)).first()
        assert abs(mean - a / (a + b)) < 0.006 and abs(variance - a * b / ((a + b) ** 2 * (a + b + 1))) < 0.003
    assert (a, b) == (1.0, 1.0)  # at the end of the way draws are uniform
    with pytest.raises(ValueError):
        schedules.draw(F.col("id"), "normal", 1, 1, 0, 1, "x")
    assert ids.select(schedules.drawn_sections(F.col("id"), 4, 4).alias("n")).distinct().collect()[0].n == 4


def test_frame_index_random(spark, sf):
    clips = {r.clip_id: r.num_frames for r in spark.read.parquet(f"{sf}/toy_filter.parquet").filter("num_frames > 0").collect()}
    got = rows_of(spark, sf, "frame_index_random", "clip_id")
    assert got.keys() == clips.keys()
    for i, n in clips.items():
        frames = [int(f) for f in got[i].frames.split(",")]
        edges = np.linspace(0, n, min(16, n) + 1).astype(int)
        assert len(frames) == 16 and frames == sorted(frames) and frames[-1] < n
        if (np.diff(edges) > 1).all():
            assert all(a <= f < b - 1 for f, a, b in zip(frames, edges, edges[1:]))
        else:
            assert len(set(frames)) == min(16, n)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_without_its_training_part():
    code = "import sys; sys.modules['cliploom.llm'] = None; import __spark_entry__ as e; assert e.llm_queries is None; assert 'leaderboard_pivot' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_a_broken_training_part_is_an_error():
    code = "import sys; sys.modules['numpy'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0], capture_output=True, text=True)
    assert done.returncode and "numpy" in done.stderr


def test_plans_read_only_what_they_need(spark, sf):
    text = QUERIES["min_len_allowed_shape"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schema = text[text.index("ReadSchema") :].split("\n")[0]
    assert "cap" not in schema and "dataset_name" not in schema
    assert "PushedFilters" in text


def test_even_distribution_of_all_words(spark, sf):
    prompts = {r.prompt_id: [w for w in re.split(r"[ \t\n\x0b\f\r]+", r.prompt) if w] for r in spark.read.parquet(f"{sf}/prompt_table.parquet").filter("prompt is not null").collect()}
    got = {r.prompt_id: r.words.split(" ") for r in QUERIES["even_distribution"](spark, sf).collect()}
    assert any(len(w) > 17 for w in prompts.values())
    for i, w in got.items():
        n, more = divmod(len(w), len(prompts[i]))
        assert len(w) == len(prompts[i]) + 5 and w == [x for k, x in enumerate(prompts[i]) for _ in range(n + (k < more))]


def test_interval_lerp_gives_whole_vectors(spark, sf):
    last, expected = {}, {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        if (p := last.get(r.label)) is not None:
            for step in range(3):
                expected[r.vec_id, step] = [x + (y - x) * step / 2 for x, y in zip(p, r.embedding, strict=True)]
        last[r.label] = r.embedding
    got = {(r.vec_id, r.step): [float(x) for x in r.vector.split(",")] for r in QUERIES["interval_lerp"](spark, sf).collect()}
    assert got.keys() == expected.keys() and {len(v) for v in got.values()} == {64}
    assert all(abs(x - y) < 1e-6 for k, v in got.items() for x, y in zip(v, expected[k], strict=True))
