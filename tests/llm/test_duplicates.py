"""Copy ledger, near-duplicate groups and cross-split overlap against brute force."""

import json
import random
from collections import defaultdict

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from cliploom.llm import candidates, ledger, neardup, overlap, shingles
from cliploom.llm.components import components
from cliploom.session import fresh_path, materialize

OTHER = regex.compile(r"[^\p{L}\p{N}]+")
WORDS = "amber bridge cloud delta ember forest garden harbor island jungle kettle lantern meadow northern ocean pebble quarry river summit tundra umbrella valley willow xenon yonder zephyr".split()


def norm(text):
    return OTHER.sub("", text).lower()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def runs(key):
    return {key[i : i + 10] for i in range(len(key) - 9)}


def similar(a, b):
    x, y = runs(a), runs(b)
    return bool(x and y) and len(x & y) / len(x | y) >= 0.5


def groups(rows):
    """Smallest id and each other member of the groups of {id: [captions]}, by comparing every pair."""
    keys = {i: sorted({norm(c) for c in caps or [] if c} - {""}) for i, caps in rows.items()}
    keys = {i: k for i, k in keys.items() if k}
    root = {i: i for i in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(keys)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if keys[a] == keys[b] or any(similar(x, y) for x in keys[a] for y in keys[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(find(i), i) for i in ids if find(i) != i}


def captions_table():
    rng = random.Random(3)
    rows, i = {}, 0
    for _ in range(25):
        base = sentence(rng, 30)
        for _ in range(rng.randint(1, 4)):
            i += 1
            rows[i] = [edited(rng, base, rng.randint(0, 6))]
            if rng.random() < 0.3:
                rows[i].append(sentence(rng, 25))
            if rng.random() < 0.2:
                rows[i] = [c.upper() + " ..." for c in rows[i]]
    rows |= {101: None, 102: [], 103: [None, "", "..."], 104: ["abc"], 105: ["A-b-c!"], 106: ["abc", rows[1][0]], 107: ["é" * 30], 108: ["É" * 30], 109: [sentence(rng, 4000)], 110: [rows[1][0], rows[9][0]]}
    hot = sentence(rng, 40)
    for k in range(60):  # a group of a third of all rows, of copies and edits
        rows[200 + k] = [hot if k % 2 else edited(rng, hot, 3)]
    return rows


@pytest.fixture(scope="module")
def table_of(spark):
    rows = captions_table()
    # columns whose names clash with the operator's own
    return rows, spark.createDataFrame([(i, c, "x", 1, "y") for i, c in rows.items()], "clip_id bigint, cap array<string>, key string, uid int, digest string")


def test_near_duplicates_equal_brute_force(table_of):
    rows, df = table_of
    entries = neardup.entries_of(df, "toy_filter", "clip_id", df["cap"])
    got = {(r.keep_id, r.dup_id) for r in neardup.similar_groups(entries).collect()}
    assert got == groups(rows)


def test_tables_do_not_mix(spark):
    df = spark.createDataFrame([(1, ["one two three four five six seven"])], "id bigint, cap array<string>")
    both = neardup.entries_of(df, "a", "id", df["cap"]).unionByName(neardup.entries_of(df, "b", "id", df["cap"]))
    assert neardup.similar_groups(both).count() == 0


def test_tables_of_the_same_near_duplicates_do_not_mix(spark):
    """Buckets of three and more texts in both tables, of which no text is in both."""
    rng = random.Random(31)
    bases = [sentence(rng, 30) for _ in range(6)]
    tables = {t: {at + k: [edited(rng, bases[k % 6], 1 + k % 5)] for k in range(60)} for t, at in (("a", 1), ("b", 1001))}
    entries = [neardup.entries_of(df := spark.createDataFrame(list(rows.items()), "id bigint, cap array<string>"), t, "id", df["cap"]) for t, rows in tables.items()]
    got = {(r.tbl, r.keep_id, r.dup_id) for r in neardup.similar_groups(entries[0].unionByName(entries[1])).collect()}
    assert got == {(t, *pair) for t, rows in tables.items() for pair in groups(rows)} and len(got) > 60


def test_copies_equal_brute_force(spark, table_of):
    rows, df = table_of
    keyed = ledger.array_record_keys(df, "t", "clip_id", "cap")
    book = ledger.build_ledger(spark, [keyed.filter("id % 3 = 0"), keyed.filter("id % 3 = 1"), keyed.filter("id % 3 = 2")])
    expected = defaultdict(list)
    for i, caps in rows.items():
        k = frozenset(norm(c) for c in caps or [] if c) - {""}
        if k:
            expected[k].append(i)
    assert {(r.keep_id, r.copies) for r in book.read().collect()} == {(min(v), len(v)) for v in expected.values()}
    found = {(r.keep_id, r.dup_id) for r in ledger.members_of(keyed, book.read(), keyed.count()).collect()}
    assert found == {(min(v), x) for v in expected.values() for x in v if x != min(v)}
    again = ledger.CopyLedger.open(spark, book.path, book.buckets)
    assert again.newest == book.newest and again.read().count() == len(expected)


@pytest.mark.parametrize("buckets, most", [(1, 1000), (16, 1_000_000), (16, 3), (256, 1000)])
def test_ledger_of_any_number_of_buckets(spark, monkeypatch, buckets, most):
    """The same counts, however many buckets there are and however many tasks write one."""
    monkeypatch.setattr(ledger, "BUCKET_ROWS", most)
    rows = spark.createDataFrame([(i, f"caption {i % 90}") for i in range(400)], "id bigint, t string")
    keyed = ledger.text_record_keys(rows, "t", "id", "t")
    book = ledger.CopyLedger.create(spark, buckets=buckets)
    for part in (keyed.filter("id < 200"), keyed.filter("id >= 200"), keyed.limit(0)):
        book = book.update(part)
    expected = {(k, 5 if k < 40 else 4) for k in range(90)}
    assert {(r.keep_id, r.copies) for r in book.read().collect()} == expected
    again = ledger.CopyLedger.open(spark, book.path)
    assert again.buckets == buckets and {(r.keep_id, r.copies) for r in again.read().collect()} == expected
    with pytest.raises(ValueError):
        ledger.CopyLedger.open(spark, book.path, buckets + 1)


def test_ledger_has_buckets_for_its_rows(spark):
    assert [ledger.CopyLedger.create(spark, rows).buckets for rows in (0, 16_000_000, 16_000_001, 10**9)] == [16, 16, 32, 1024]


def test_ledger_takes_only_touched_buckets(spark):
    rows = spark.createDataFrame([(i, f"caption number {i} of many") for i in range(200)], "id bigint, t string")
    keyed = ledger.text_record_keys(rows, "t", "id", "t")
    book = ledger.build_ledger(spark, [keyed, keyed.filter("id = 7")])
    assert sorted(book.newest.values()).count(2) == 1
    assert {r.copies for r in book.read().collect()} == {1, 2} and book.read().count() == 200


def test_json_records():
    same = ['{"a": 1, "b": [24.0, {"c": "x"}], "cap": ["A b!", "..."]}', ' {"cap":["a B"],"b":[24,{"c":"x"}],"a":1.0e0},\r', '{"b":[2.4e1,{"c":"\\u0078"}],"a":1,"cap":[null,"AB"]}']
    other = ['{"a": 1, "b": [24.1, {"c": "x"}], "cap": ["ab"]}', '{"a": "1", "b": [24, {"c": "x"}], "cap": ["ab"]}', '{"a": 1, "b": [24, {"c": "X"}], "cap": ["ab"]}', '{"a": true, "b": [24, {"c": "x"}], "cap": ["ab"]}']
    keys = [ledger.canonical_json(x, "cap", norm) for x in same + other]
    assert len(set(keys[:3])) == 1 and len(set(keys)) == 5 and None not in keys
    for bad in (None, "", "{", '{"a": 1', "5", "[1]", '{"a": NaN}', "[" * 5000, '{"a": 1} {"b": 2}'):
        assert ledger.canonical_json(bad, "cap", norm) is None
    assert ledger.canonical_json('{"n": -0.0}', "cap", norm) == ledger.canonical_json('{"n": 0}', "cap", norm)
    assert ledger.canonical_json('{"n": 1e400}', "cap", norm) != ledger.canonical_json('{"n": 1e401}', "cap", norm)


def test_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    train = {i: [sentence(rng, 25)] for i in range(40)}
    train |= {100: None, 101: [None, "", "?"], 102: ["short"], 103: train[1] + [sentence(rng, 20)], 104: list(train[1])}
    held = {i: edited(rng, train[i % 40][0], rng.randint(0, 9)) for i in range(60)}
    held |= {100: None, 101: " ", 102: "short", 103: train[1][0].upper()}
    e = spark.createDataFrame(list(held.items()), "id bigint, prompt string")
    t = spark.createDataFrame(list(train.items()), "clip_id bigint, cap array<string>")
    got = {(r.eval_id, r.train_id) for r in overlap.overlapping_pairs(overlap.text_entries(e, "id", "prompt"), overlap.array_entries(t, "clip_id", "cap")).collect()}
    expected = {(a, b) for a, p in held.items() for b, caps in train.items() if any(similar(norm(p or ""), norm(c)) for c in caps or [] if c)}
    assert got == expected and expected


def test_split_bands_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(9)
    texts = spark.createDataFrame([(norm(sentence(rng, 12)) if i % 3 else "samestart" + "x" * 30 + str(i % 7),) for i in range(300)], "key string")
    numbered = candidates.numbered(texts.coalesce(3))
    from cliploom.session import materialize

    numbered = materialize(numbered, "t")
    plan = shingles.Plan(3, 16)
    whole = candidates.star_pairs(candidates.band_rows(numbered, plan, 300))
    monkeypatch.setattr(candidates, "PART_TEXTS", 40)
    parts = candidates.star_pairs(candidates.band_rows(numbered, plan, 300))
    pairs = lambda d: {(r.a, r.b) for r in d.collect()}
    assert pairs(whole) == pairs(parts) and pairs(whole)
    # Hot hashes apart: other stars of the same buckets, which hang together as before.
    monkeypatch.setattr(candidates, "HOT_IN_BATCH", 5)
    monkeypatch.setattr(candidates, "SIGNED_TEXTS", 40)
    bands = materialize(candidates.band_rows(numbered, plan, 300, split_hot=True), "b")
    assert bands.filter(F.col("part") >= candidates.band_parts(300)).count()
    stars = candidates.star_pairs(bands, True)
    assert {(r.uid, r.comp) for r in components(stars).collect()} == {(r.uid, r.comp) for r in components(whole).collect()}
    members = lambda d: {(r.bucket & 0xFFFFFFFFFFFF, u) for r in d.filter("bucket is not null").collect() for u in (r.a, r.b)}
    assert members(whole) <= members(stars)


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    base = norm(sentence(rng, 120))
    other = base[:400] + norm(sentence(rng, 60))
    s, filled = shingles.signatures([base, other, "short", ""], 512)
    true = len(runs(base) & runs(other)) / len(runs(base) | runs(other))
    assert abs((s[0] == s[1]).mean() - true) < 0.1 and (filled[2:] == 0).all()
    assert shingles.jaccard(*shingles.sets_of([base, other])) == pytest.approx(true)


def test_cross_pairs_in_blocks_and_pieces(spark, monkeypatch):
    """One bucket of nearly all texts of both sides: no table of more than a block, and the pairs of a direct comparison."""
    rng = random.Random(21)
    hot = sentence(rng, 40)
    e = spark.createDataFrame([(i, edited(rng, hot, i % 9)) for i in range(150)] + [(900, sentence(rng, 30))], "id bigint, prompt string")
    t = spark.createDataFrame([(i, [edited(rng, hot, i % 7)]) for i in range(200)], "clip_id bigint, cap array<string>")
    sides = overlap.text_entries(e, "id", "prompt"), overlap.array_entries(t, "clip_id", "cap")
    texts = [materialize(candidates.numbered(s.select("key").distinct()), "t") for s in sides]
    n, m = (x.count() for x in texts)
    plan = shingles.Plan(1, 4)  # a pair in every bucket that shares one value
    bands = candidates.band_rows(texts[0], plan, n, side=0).unionByName(candidates.band_rows(texts[1], plan, m, side=1))
    tasks = []
    monkeypatch.setattr(type(bands.groupBy("band")), "applyInArrow", lambda self, f, schema: tasks.append(f))
    for block in (64, 1 << 16):
        candidates.cross_pairs(bands, block)
    by_band = [bands.filter(F.col("band") == k).toArrow().to_batches() for k in range(plan.bands)]
    for most in (1 << 12, 1 << 40):
        monkeypatch.setattr(candidates, "LARGE_BUCKET", most)
        in_blocks, whole = ([b for k, rows in enumerate(by_band) for b in f((pa.scalar(k), pa.scalar(0)), iter(rows))] for f in tasks)
        assert max(b.num_rows for b in in_blocks) == 64
        rows = [sorted(map(repr, pa.Table.from_batches(x).to_pylist())) for x in (in_blocks, whole)]
        assert rows[0] == rows[1]
        assert any("'bucket': None" not in r for r in rows[0]) == (most == 1 << 12)


@pytest.mark.parametrize("large, piece", [(1 << 12, 512), (8, 7), (0, 1)])
def test_large_buckets_equal_brute_force(spark, monkeypatch, large, piece):
    rng = random.Random(22)
    hot = sentence(rng, 40)
    held = {i: edited(rng, hot, i % 9) for i in range(120)} | {900: sentence(rng, 30), 901: None}
    train = {i: [edited(rng, hot, i % 6)] for i in range(140)} | {900: [held[900]]}
    monkeypatch.setattr(candidates, "LARGE_BUCKET", large)
    monkeypatch.setattr(candidates, "PIECE", piece)
    e = spark.createDataFrame(list(held.items()), "id bigint, prompt string")
    t = spark.createDataFrame(list(train.items()), "clip_id bigint, cap array<string>")
    plan = shingles.Plan(2, 96)
    got = {(r.eval_id, r.train_id) for r in overlap.overlapping_pairs(overlap.text_entries(e, "id", "prompt"), overlap.array_entries(t, "clip_id", "cap"), plan=plan).collect()}
    expected = {(a, b) for a, p in held.items() for b, caps in train.items() if similar(norm(p or ""), norm(caps[0]))}
    assert got == expected and len(expected) > 4096


SIZES = [2_000_000, 40_000_000, 40_000_001]


@pytest.mark.parametrize("texts", SIZES)
def test_no_plan_misses_more_than_the_first(texts):
    missed = lambda plan, s: (1 - s**plan.rows) ** plan.bands
    plan, first = shingles.plan_for(texts), shingles.plan_for(1)
    assert all(missed(plan, s / 100) <= missed(first, s / 100) for s in range(50, 101))
    assert missed(plan, 0.5) < 0.0173 and missed(plan, 0.55) < 0.0014 and missed(shingles.NEARLY_EXACT, 0.5) < 1e-9
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pairs = []
    for _ in range(2000):
        base = letters(360)
        pairs.append((base, base[:244] + letters(116)))
    least = [shingles.jaccard(*shingles.sets_of(list(p))) for p in pairs[:100]]
    assert min(least) >= 0.5 and max(least) < 0.52
    a, b = (shingles.band_hashes(shingles.signatures(list(side), plan.bins)[0], plan) for side in zip(*pairs))
    assert 1 - (a == b).any(axis=0).mean() < 0.023


@pytest.mark.parametrize("letters", [12, 30, 60, 150, 400])
def test_sketches_turn_away_hardly_any_pair_at_the_threshold(spark, letters):
    """Texts of all lengths that share just over half of their runs, against the screen's rule."""
    rng = random.Random(letters)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    while len(texts) < 12_000:
        base = some(letters)
        keep = letters - max(1, (letters - 9) // 3)
        pair = base, base[:keep] + some(letters - keep)
        if shingles.jaccard(*shingles.sets_of(list(pair))) >= 0.5:
            texts += pair
        else:
            texts += [base, base + some(1)] if letters < 40 else [base, base[:-3] + some(3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid bigint, key string")
    sketch = materialize(candidates.sketch_rows(rows), "sketch")
    pairs = rows.filter("uid % 2 = 0").select(F.col("uid").alias("a"), (F.col("uid") + 1).alias("b"))
    assert candidates.likely(pairs, sketch, sketch, 0.5).count() == 6000
    assert candidates.likely(pairs.select("a", ((F.col("b") + 501) % 12_000).alias("b")), sketch, sketch, 0.5, screen=False).count() == 6000


def test_a_large_bucket_meets_in_pieces(spark, monkeypatch):
    """Chains of edits that all fall in one bucket; the result is that of a direct comparison, however small the pieces."""
    rng = random.Random(41)
    chains = {}
    for c in range(4):
        text = "every one begins with the very same long words " + sentence(rng, 12)
        for k in range(15):
            chains[c * 100 + k] = [text]
            text = edited(rng, text, 3)
    df = spark.createDataFrame(list(chains.items()), "id bigint, cap array<string>")
    entries = neardup.entries_of(df, "t", "id", df["cap"])
    monkeypatch.setattr(candidates, "PIECE", 7)
    for screen in (True, False):
        got = {(r.keep_id, r.dup_id) for r in neardup.similar_groups(entries, plan=shingles.Plan(1, 12), screen=screen).collect()}
        assert got == groups(chains)


@pytest.mark.parametrize("texts", SIZES)
def test_each_plan_against_brute_force(spark, table_of, texts):
    """A plan may miss 4.75 % of the pairs at the threshold and finds nearly all others; what it finds is right."""
    plan, (rows, df) = shingles.plan_for(texts), table_of
    home = {i: keep for keep, i in groups(rows)}
    entries = neardup.entries_of(df, "toy_filter", "clip_id", df["cap"])
    got = {(r.keep_id, r.dup_id) for r in neardup.similar_groups(entries, plan=plan).collect()}
    assert all(home.get(a, a) == home[b] for a, b in got) and len(got) >= len(home) - 2
    held = df.filter("clip_id % 3 = 0").select("clip_id", F.get("cap", F.lit(0)).alias("prompt"))
    pairs = overlap.overlapping_pairs(overlap.text_entries(held, "clip_id", "prompt"), overlap.array_entries(df, "clip_id", "cap"), plan=plan)
    sides = [[(r.clip_id, norm(r.prompt or "")) for r in held.collect()], [(i, norm(c)) for i, caps in rows.items() for c in caps or [] if c]]
    expected = {(i, k) for i, x in sides[0] for k, y in sides[1] if similar(x, y)}
    found = {(r.eval_id, r.train_id) for r in pairs.collect()}
    assert found <= expected and len(found) > 0.98 * len(expected)


@pytest.mark.parametrize("small", [0, 3, 10**6])
def test_components(spark, small):
    rng = random.Random(small)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r.uid: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), small).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[find(a)] = find(b)
    by = defaultdict(set)
    for x in root:
        by[find(x)].add(x)
    mine = defaultdict(set)
    for x, c in got.items():
        mine[c].add(x)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, mine.values()))


def test_whole_tables_equal_brute_force(spark, sf):
    rows = {r.prompt_id: [r.prompt] for r in spark.read.parquet(f"{sf}/prompt_table.parquet").select("prompt_id", "prompt").collect()}
    got = {(r.keep_id, r.dup_id) for r in neardup.p4_found(spark, sf).filter("tbl = 'prompt_table'").collect()}
    assert got == groups(rows)
    assert json.dumps(sorted(got))
    assert fresh_path(spark, "x") != fresh_path(spark, "x") and F is not None
