"""Encoding, packing and language."""

import base64
import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliploom.llm import encode, language, packing
from cliploom.llm.wikitext import paragraphs, sentences

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(alphabet="ab Zz\n\t'é中1　<|>.\U0001f469‍\x1c\x85 ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_library(reference, text):
    bpe = encode.ByteBPE.load(encode.default_vocabulary())
    assert bpe.ids(text) == reference.encode_ordinary(text)


def test_long_words_and_both_merges(reference):
    bpe = encode.ByteBPE.load(encode.default_vocabulary())
    rng = random.Random(2)
    for word in ("x" * 3000, "ab" * 2000, "中é" * 500, "".join(rng.choice("etaoin") for _ in range(5000))):
        assert bpe.ids(word) == reference.encode_ordinary(word)
        assert encode.heap_merge(word[:90].encode(), bpe.ranks) == encode.rank_array_merge(word[:90].encode(), bpe.ranks)


def test_encode_table(spark, reference):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (None, "a", "x"), (4, " lead  and trail \r\n" * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _id string")
    got = sorted([(r.doc_id, list(r.ids)) for r in encode.encode_texts(df).collect()], key=repr)
    assert got == sorted([(i, reference.encode_ordinary(t) if t else []) for i, t, _ in rows], key=repr)
    assert encode.encode_texts(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert encode.encode_texts(df.limit(0)).count() == 0
    assert {r.doc_id: r.tokens for r in encode.token_counts(df).collect()}[2] == 0


def test_texts_are_encoded_in_bounded_batches(reference, monkeypatch):
    texts = ["a b", "", None, "x " * 100, "end"]
    batch = pa.RecordBatch.from_pydict({"_id": list(range(5)), "_text": texts})
    monkeypatch.setattr(encode, "BATCH_BYTES", 4)
    run = encode._over_batches("_text", encode.default_vocabulary(), lambda b, packed: (b.num_rows, [len(p) // 4 for p in packed]))
    got = list(run([batch, batch.slice(0, 0)]))
    assert [n for n, _ in got] == [3, 1, 1]
    assert [n for _, many in got for n in many] == [len(reference.encode_ordinary(t or "")) for t in texts]


def check_packing(rows, sizes, targets):
    where = defaultdict(lambda: defaultdict(list))
    for r in rows:
        where[r.target_id][r.doc].append(r)
    used = {}
    for target, capacity, _ in targets:
        assert set(where[target]) == set(sizes)
        load = defaultdict(int)
        for doc, n in sizes.items():
            pieces = sorted(where[target][doc], key=lambda r: r.piece)
            assert sum(p.tokens for p in pieces) == n and [p.piece for p in pieces] == list(range(1, len(pieces) + 1))
            assert len(pieces) == max(1, -(-n // capacity)) and all(p.tokens == capacity for p in pieces[:-1])
            for p in pieces:
                if n:
                    load[p.container_id] += p.tokens
                else:
                    assert p.container_id is None
        assert not load or max(load.values()) <= capacity
        assert set(load) == set(range(len(load)))
        used[target] = sum(load.values()) / (len(load) * capacity) if load else 1.0
    return used


@pytest.mark.parametrize("kind", ["mixed", "equal", "tiny", "empty"])
def test_packing(spark, kind):
    rng = random.Random(4)
    sizes = {"mixed": {i: int(rng.lognormvariate(5.5, 1)) for i in range(3000)} | {9000: 0, 9001: 100_000}, "equal": {i: 300 for i in range(500)}, "tiny": {1: 1}, "empty": {}}[kind]
    targets = [(1, 512, "t"), (2, 5000, "t"), (3, 1, "t")] if kind != "mixed" else [(1, 512, "t"), (2, 5000, "t")]
    df = spark.createDataFrame([(i, "t", n) for i, n in sizes.items()], "doc bigint, tokenizer string, tokens bigint")
    used = check_packing(packing.pack(df, [*targets, (8, 0, "t"), (9, None, "t")]).collect(), sizes, targets)
    if kind == "mixed":
        assert used[1] > 0.99 and used[2] > 0.995


def test_best_configuration_is_best():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = np.flatnonzero(rng.random(9) < 0.5) + 1
        prices, limits = rng.random(len(lengths)), rng.integers(1, 4, len(lengths))
        config = packing.best_configuration(lengths, prices, limits, 12)
        assert config @ lengths <= 12 and (config <= limits).all()
        fillings = itertools.product(*(range(n + 1) for n in limits))
        assert config @ prices == pytest.approx(max(sum(np.array(f) * prices) for f in fillings if sum(np.array(f) * lengths) <= 12))


def test_program_places_all_items_near_the_bound():
    rng = random.Random(7)
    for room, n in ((64, 3000), (300, 3000), (1, 50)):
        counts = np.zeros(room, dtype=np.int64)
        for _ in range(n):
            counts[min(room, max(1, int(rng.lognormvariate(2.5, 1)))) - 1] += 1
        uses = packing.solve(counts, packing.FALLS[0])
        size = np.arange(1, room + 1)
        assert all(t > 0 and c @ size <= room for c, t in uses) and (sum(t * c for c, t in uses) == counts).all()
        bound = packing.least_containers(counts)
        assert -(-int(counts @ size) // room) <= bound <= sum(t for _, t in uses) <= bound * 1.02 + 1
    big = np.zeros(100, dtype=np.int64)
    big[59], big[49] = 10, 5  # ten items of 60 need ten containers and five of 50 three more, whatever their volume
    assert packing.least_containers(big) == 13 == sum(t for _, t in packing.solve(big, 0.3))


PAGE = """{{Infobox place
| name = Xy
}}
'''Xy Zed''' is a village in the district of Abc.<ref name="r">{{cite book|title=Das Buch}}</ref> The {{lang|old}} bridge was built ("Die alte Brücke") [[Abc|near]] the town.

== Kultur ==
<!-- Kein Satz hier. -->
{| class="wikitable"
| Das ist eine Zelle. || 5
|}
[[Datei:X.jpg|thumb|Ein Bild.]]
[[Kategorie:Dorf]]
#REDIRECT [[Abc]]
qwxz sdkfj
"""


def test_wikitext():
    got = sentences(PAGE)
    assert [s.split()[0] for s in got] == ["Xy", "The"] and "Brücke" not in " ".join(got) and "near" in got[1]
    assert sentences("") == [] and paragraphs("{{a|{{b}}}} x") == ["x"]
    assert sentences("{| unclosed\n| A cell with words.\nText goes on here.") == ["Text goes on here."]
    assert len(sentences("Eins ist da. " * 2 + "一个村庄在这里。" * 2)) == 4


def test_short_sentences_and_long_quotations():
    assert sentences("他是医生。她来自北京市。") == ["他是医生。", "她来自北京市。"]
    assert sentences("I go. We came home late yesterday.") == ["I go.", "We came home late yesterday."]
    assert sentences("J. R. Miller came on 3. May with Dr. Jones.") == ["J. R. Miller came on 3.", "May with Dr.", "Jones."]
    quoted = "Das ist ein langes Zitat, das nicht zum Satz gehört, " * 8
    assert len(quoted) > 400
    for opening, closing in ('""', "“”", "«»", "()", ("''", "''")):
        assert sentences(f"He said {opening}{quoted}{closing} and left the room.") == ["He said  and left the room."]
    assert sentences('A 5" board and a 7" board lay there.') == ['A 5" board and a 7" board lay there.']
    assert sentences('("' * 20000 + " It ends here.") and sentences("... !!! ???") == []


def test_other_scripts_come_apart(spark):
    greek, arabic = "Το χωριό βρίσκεται κοντά στη θάλασσα και έχει λίγους κατοίκους.", "تقع القرية بالقرب من البحر ويسكنها عدد قليل من الناس."
    trained = language.Profiles.train([("el", greek), ("ar", arabic), ("en", "The village lies near the sea and few people live there.")])
    near = trained.distances(["Η πόλη βρίσκεται στη θάλασσα.", "تقع المدينة بالقرب من البحر.", "The town lies near the sea."])[0].argmin(axis=1)
    assert [trained.languages[i] for i in near] == ["el", "ar", "en"]


@pytest.fixture(scope="module")
def profiles(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/lang_sample.parquet").collect()]
    return rows, language.Profiles.train(sorted(rows))


def test_held_out_accuracy(profiles):
    rows, _ = profiles
    right = 0
    for part in range(4):
        trained = language.Profiles.train(sorted(r for i, r in enumerate(rows) if i % 4 != part))
        held = [r for i, r in enumerate(rows) if i % 4 == part]
        nearest = trained.distances([t for _, t in held])[0].argmin(axis=1)
        right += sum(trained.languages[i] == lang for i, (lang, _) in zip(nearest, held))
    assert right / len(rows) > 0.9


def test_mixed_pages_come_apart(profiles):
    rows, trained = profiles
    by = defaultdict(list)
    for lang, text in rows:
        by[lang].append(text if text[-1] in ".。" else text + ".")
    detector = language.Detector(trained)
    pages = [" ".join(by["en"][:6]) + "\n\n" + " ".join(by["de"][:4]) + "\n\n" + " ".join(by["en"][6:10]), " ".join(by["ru"][:5]), None, "", "{{stub}}", " ".join(by["fr"][:1]), "!!! ??? ...", by["en"][0] * 4000]
    spans = list(detector.spans(pages))
    assert [(s[2], s[1]) for s in spans[0][1:]] == [("en", 6), ("de", 4), ("en", 4)] and spans[0][0][2] == "en"
    assert [s[2] for s in spans[1]] == ["ru"] and spans[2:5] == [[], [], []] and spans[5][0][2] == "fr" and spans[6] == []
    assert all(0 <= c <= 1 for s in spans for _, _, _, c, _ in s)


def test_labels():
    for label, code in (("en", "en"), ("EN_us", "en"), ("Deutsch", "de"), ("français", "fr"), ("fre", "fr"), ("pt-BR", "pt"), ("中文", "zh"), ("русский", "ru"), ("oc", "other"), ("Klingon", "other")):
        assert language.label_language(label) == code
    for label in (None, "", "  ", "und", "mul", "??", "-", "n/a", "xx", "unknown"):
        assert language.label_language(label) is None


def test_stretches_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(30):
        costs = rng.random((7, 3))
        if (costs.argmin(axis=1) == costs.argmin(axis=1)[0]).all():
            continue

        def total(lang):
            runs = [len(list(g)) for _, g in itertools.groupby(lang)]
            return np.inf if min(runs) < 2 else costs[range(7), lang].sum() + 0.1 * (len(runs) - 1)

        best = min(itertools.product(range(3), repeat=7), key=total)
        assert total(language.stretches(costs, 0.1).tolist()) == pytest.approx(total(best))


def test_language_table(spark, sf):
    samples = spark.read.parquet(f"{sf}/lang_sample.parquet")
    docs = samples.groupBy("lang").agg(F.concat_ws(" ", F.collect_list(F.concat("text", F.lit(" ")))).alias("text")).withColumn("doc_id", F.row_number().over(__import__("pyspark.sql").sql.Window.orderBy("lang")).cast("bigint"))
    docs = docs.withColumn("label", F.when(F.col("lang") == "de", "und").when(F.col("lang") == "en", "French").otherwise(F.col("lang"))).withColumn("seg_no", F.lit("clash"))
    spans = language.language_spans(docs, samples, label_col="label")
    rows = {r.doc_id: r for r in spans.filter("seg_no = 0").collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert {i: r.lang for i, r in rows.items()} == truth
    assert {truth[i] for i, r in rows.items() if r.named != r.lang} == {"de", "en"}
    assert language.language_spans(docs.limit(0), samples, label_col="label").count() == 0
