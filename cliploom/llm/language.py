"""Problem 8: the language of every document and of every stretch of a mixed one.

Method: rank-order profiles. A language's profile ranks the n-grams (one to four symbols, within words) of its sample
sentences by frequency. A text's n-grams are ranked likewise, and its distance to a language is the sum of how far each
n-gram is out of place there; one that the profile lacks counts as far as the profile is long. Sentences of running text
are compared, whole batches at a time; the page's stretches are the cheapest cut of its sentences into runs of at least
two in one language.

The sample sentences are few, so profiles are fitted again: from them first, then twice from the sentences of a bounded sample of
labelled documents, as far as the profiles before put them in the language that the label names.

Letters are folded to base letters, so missing accents and composed or decomposed forms are the same.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.wikitext import sentences
from cliploom.session import spread, table

#: Names of the languages in labels, lower-case and without accents.
LANGUAGE_NAMES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish espanol castellano",
    "fr": "fr fra fre french francais",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "pt": "pt por portuguese portugues",
    "ru": "ru rus russian русскии",
    "sv": "sv swe swedish svenska",
    "zh": "zh zho chi chinese 中文 汉语 漢語 普通话",
}
_BY_NAME = {name: code for code, names in LANGUAGE_NAMES.items() for name in names.split()}

#: Sample sentences and labelled documents used at most to fit the profiles, the characters such a document has at most,
#: and the n-grams a profile holds.
SAMPLE_ROWS = 20_000
FIT_DOCUMENTS = 1_500
FIT_CHARS = 50_000
PROFILE = 1500
#: Sentences of which fewer than this share of n-grams are in any profile are gibberish.
KNOWN_SHARE = 0.3
#: And so are those that repeat the same few n-grams.
VARIED_SHARE = 0.1
#: What a change of language costs, in sentences' worth of distance.
SWITCH = 0.04
MEMO = 1 << 16

#: Numbers of letters: Latin 1 to 26, Cyrillic from 27, ideographs from 64, other scripts from here, by code point.
_OTHER = 1 << 18


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def label_language(label: str | None) -> str | None:
    """The two-letter code a label names, "other" for any other name, None for a label that names no language."""
    if label is None:
        return None
    name = fold(label).strip()
    if name in _BY_NAME:
        return _BY_NAME[name]
    head = name.replace("_", "-").split("-")[0].split("(")[0].strip()
    return _BY_NAME.get(head, "other" if head.isalpha() and head not in ("und", "mul", "unknown", "none", "null", "xx", "na") else None)


def _symbols() -> np.ndarray:
    """Symbol of each code point of the basic plane: 0 no letter, 255 to be left out, ideographs for themselves."""
    out = np.zeros(1 << 16, dtype=np.uint32)
    cyrillic = {c: 27 + i for i, c in enumerate("абвгдежзиклмнопрстуфхцчшщъыьэюя")}
    for cp in range(1 << 16):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind[0] == "M" or cp in (0x200B, 0xFEFF, 0xAD):
            out[cp] = 255
        elif kind[0] == "L":
            base = fold(c)[:1]
            if "a" <= base <= "z":
                out[cp] = ord(base) - 96
            elif base in cyrillic:
                out[cp] = cyrillic[base]
            elif 0x3400 <= cp < 0xA000:
                out[cp] = 64 + cp
            else:
                out[cp] = _OTHER + cp
    return out


_SYMBOLS = _symbols()
LONGEST = 4
#: N-grams are looked up by a hash of this many bits.
HASH_BITS = 22
_MULTIPLIER = 0x9E3779B1
IDEOGRAPH_LETTERS = 3
_CLASS_GRAM = 1


def _main_script(sym: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """``sym`` with the letters of other scripts than each text's main one made blanks."""
    script = np.searchsorted(np.array([1, 27, 64, _OTHER]), sym, side="right")  # 0 none, 1 Latin, 2 Cyrillic, 3 ideographs, 4 other
    amount = np.bincount(owner.astype(np.int64) * 5 + script, minlength=texts * 5).reshape(texts, 5).astype(np.int64)
    amount[:, 0] = 0
    amount[:, 3] *= IDEOGRAPH_LETTERS
    return np.where(script == amount.argmax(axis=1)[owner], sym, 0).astype(np.uint32)


def grams(texts: list[str], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts, of one to ``longest`` symbols with blanks only at their ends, and the text each
    is from. Only letters of the script most of a text is written in count, an ideograph for ``IDEOGRAPH_LETTERS``; so names
    in another script do not decide. Ideographs have n-grams of at most two, and each also counts as one of its script."""
    padded = [" " + t + " " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _SYMBOLS[np.where(codes < 1 << 16, codes, 0)]
    beyond = codes >= 1 << 16
    sym[beyond] = np.where(codes[beyond] >> 17 == 1, codes[beyond], 0)  # planes 2 and 3 hold ideographs, plane 1 mostly signs
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    keep = sym != 255
    sym, owner = sym[keep], owner[keep]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    keep[1:] |= owner[1:] != owner[:-1]
    sym, owner = sym[keep], owner[keep]
    if longest > 1 and (sym > 26).any():
        sym = _main_script(sym, owner, len(texts))
    ideograph = (sym >= 64) & (sym < _OTHER)
    ids, owners = [np.full(int(ideograph.sum()), _CLASS_GRAM, dtype=np.int32)], [owner[ideograph]]
    value, plain = sym, ~ideograph
    # inner: every symbol after the first and before the last is a letter
    inner = np.ones(len(sym), bool)
    for n in range(1, longest + 1):
        if n > 1:
            value = value[:-1] * np.uint32(67) + sym[n - 1 :]
            inner = inner[:-1] if n == 2 else inner[:-1] & (sym[n - 2 : len(sym) - 1] != 0)
        ok = inner & ((sym[: len(value)] != 0) | (sym[n - 1 :] != 0) if n < 3 else inner)
        if n > 1:
            ok &= owner[: len(value)] == owner[n - 1 :]
        if n > 2:
            ok &= plain[1 : len(value) + 1]
        hashed = (value[ok] + np.uint32(n)) * np.uint32(_MULTIPLIER) >> np.uint32(32 - HASH_BITS)
        ids.append(hashed.astype(np.int32))
        owners.append(owner[: len(value)][ok])
    return np.concatenate(ids), np.concatenate(owners)


@dataclass(frozen=True)
class Profiles:
    """vocabulary: number of each n-gram among those of any profile, or -1; ranks: its rank in each language."""

    languages: list[str]
    vocabulary: np.ndarray
    ranks: np.ndarray

    @classmethod
    def train(cls, samples: Iterable[tuple[str, str]], size: int = PROFILE) -> "Profiles":
        texts: dict[str, list[str]] = {}
        for lang, text in samples:
            if lang and text:
                texts.setdefault(lang, []).append(text)
        languages, ranked, overall = sorted(texts), [], Counter()
        for lang in languages:
            counts = Counter(grams(texts[lang])[0].tolist())
            ranked.append([g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]])
            total = sum(counts.values())
            overall.update({g: counts[g] / total for g in ranked[-1]})
        order = [g for g, _ in sorted(overall.items(), key=lambda x: (-x[1], x[0]))]
        vocabulary = np.full(1 << HASH_BITS, -1, dtype=np.int16)
        vocabulary[order] = np.arange(len(order))
        ranks = np.full((len(order), len(languages)), size, dtype=np.int16)
        for i, grams_of in enumerate(ranked):
            ranks[vocabulary[grams_of], i] = np.arange(len(grams_of))
        return cls(languages, vocabulary, ranks)

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean out-of-place distance (0 to 1) of each text to each language, the share of its n-grams that any profile
        has, and how many of these are different ones. A text without letters is at distance 1 from all."""
        n, far = len(texts), int(self.ranks.max(initial=1))
        ids, owner = grams(texts)
        total = np.bincount(owner, minlength=n)
        v = self.vocabulary[ids]
        owner, v = owner[v >= 0], v[v >= 0]
        size = len(self.ranks)
        if not len(v):
            return np.ones((n, len(self.languages))), np.zeros(n), np.zeros(n)
        key = np.sort(owner.astype(np.int64) * size + v)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.minimum(np.diff(np.r_[first, len(key)]), 1023)
        key = key[first]
        # rank within the text: more frequent first, then the commoner of all languages
        key = np.sort(((key // size) * 1024 + (1023 - count)) * size + key % size)
        text, v = key // (1024 * size), key % size
        count = 1023 - key // size % 1024
        start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        rank = np.arange(len(text)) - np.repeat(start, np.diff(np.r_[start, len(text)]))
        place = self.ranks[v]
        out = np.abs(np.minimum(rank, far).astype(np.int16)[:, None] - place)
        out[place == far] = far
        weight = np.bincount(text, weights=count, minlength=n)
        kinds = np.bincount(text, minlength=n)
        strange = np.maximum(total - weight, 0)
        sums = np.zeros((n, len(self.languages)))
        sums[text[start]] = np.add.reduceat(out.astype(np.int32), start, axis=0)
        distance = (sums + strange[:, None] * far) / np.maximum(kinds + strange, 1)[:, None] / far
        distance[total == 0] = 1.0
        return distance, weight / np.maximum(total, 1), kinds / np.maximum(weight, 1)


def stretches(costs: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each sentence when every run has at least two sentences (unless the page has only one), by least
    total distance plus ``switch`` for each change."""
    n, k = costs.shape
    best = costs.argmin(axis=1)
    if n < 4 or (best == best[0]).all():
        total = costs.sum(axis=0)
        return np.full(n, int(total.argmin()))
    # run[i]: cheapest cost of the first i sentences where a run of language j ends at i with two or more sentences
    run, back = np.full((n + 1, k), np.inf), np.zeros((n + 1, k), dtype=np.int64)
    best_end = np.full(n + 1, np.inf)
    best_end[0], best_lang = 0.0, np.zeros(n + 1, dtype=np.int64)
    for i in range(2, n + 1):
        stay = run[i - 1] + costs[i - 1]
        fresh = best_end[i - 2] + (switch if i > 2 else 0.0) + costs[i - 2] + costs[i - 1]
        run[i] = np.minimum(stay, fresh)
        back[i] = fresh < stay
        best_lang[i] = run[i].argmin()
        best_end[i] = run[i][best_lang[i]]
    out, i = np.zeros(n, dtype=np.int64), n
    lang = int(best_lang[n])
    while i > 0:
        if back[i, lang]:
            out[i - 2 : i] = lang
            i -= 2
            lang = int(best_lang[i])
        else:
            out[i - 1] = lang
            i -= 1
    return out


def refit(profiles: Profiles, samples: list[tuple[str, str]], labelled: Iterable[tuple[str | None, str]], size: int = PROFILE, turns: int = 2) -> Profiles:
    """Profiles from the samples and from those stretches of labelled pages that are in the language of the label."""
    pages = [(label_language(label), sentences(text)) for label, text in labelled]
    pages = [(lang, page) for lang, page in pages if lang in profiles.languages and page]
    distinct = sorted({s for _, page in pages for s in page})
    for _ in range(turns):
        place: dict[str, np.ndarray] = {}
        for at in range(0, len(distinct), 2000):
            part = distinct[at : at + 2000]
            distance, known, _ = profiles.distances(part)
            place.update((s, d) for s, d, k in zip(part, distance, known) if k >= KNOWN_SHARE)
        fit = set(samples)
        for lang, page in pages:
            page = [s for s in page if s in place]
            if page:
                own = stretches(np.array([place[s] for s in page])) == profiles.languages.index(lang)
                fit.update((lang, s) for s, yes in zip(page, own) if yes)
        profiles = Profiles.train(sorted(fit), size)
    return profiles


class Detector:
    """Finds the spans of pages; remembers sentences, as revisions of a page share most of them."""

    def __init__(self, profiles: Profiles):
        self.profiles, self.memo = profiles, {}

    def spans(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, str, float, int]]]:
        """Per text: (segment, sentences, language, confidence, letters); segment 0 is the page, further ones exist only
        for pages of several languages. A page without a sentence gives an empty list."""
        pages = [sentences(t) if t else [] for t in texts]
        new = list({s for p in pages for s in p if s not in self.memo})
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list({s for p in pages for s in p})
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            distance, known, varied = self.profiles.distances(part)
            for s, d, k, v in zip(part, distance, known, varied):
                self.memo[s] = (d, k >= KNOWN_SHARE and v >= VARIED_SHARE)
        for page in pages:
            rated = [(self.memo[s][0], len(s)) for s in page if self.memo[s][1]]
            yield self._page(np.array([d for d, _ in rated]), np.array([n for _, n in rated])) if rated else []

    def _page(self, costs: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, str, float, int]]:
        lang = stretches(costs)
        cuts = np.r_[0, np.flatnonzero(lang[1:] != lang[:-1]) + 1, len(lang)]
        names = self.profiles.languages
        shares = np.bincount(lang, weights=sizes, minlength=len(names))
        main = int(shares.argmax())
        out = [(0, len(lang), names[main], self._confidence(costs, sizes, main) * float(shares[main] / shares.sum()), int(sizes.sum()))]
        if len(cuts) > 2:
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                out.append((i + 1, int(b - a), names[lang[a]], self._confidence(costs[a:b], sizes[a:b], int(lang[a])), int(sizes[a:b].sum())))
        return out

    @staticmethod
    def _confidence(costs: np.ndarray, sizes: np.ndarray, lang: int) -> float:
        """How much nearer the language is than the next one, from 0 to 1."""
        mean = (costs * sizes[:, None]).sum(axis=0) / sizes.sum()
        others = np.delete(mean, lang)
        if not len(others):
            return 1.0
        return float(np.clip((others.min() - mean[lang]) / max(others.min(), 1e-9) * 4, 0.0, 1.0))


SPANS = "_id bigint, seg_no int, sentences int, lang string, confidence double, label string, named string"


def language_spans(documents: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, seg_no, sentences, lang, confidence, label, named) of every document with a sentence.

    seg_no 0 is the document, 1, 2, ... are its stretches if it has sentences in several languages. ``named`` is the code
    the label names, "other", or null. Null and empty texts and pages of markup only have no rows. Profiles are fitted
    on at most ``SAMPLE_ROWS`` rows of (lang, text) in ``samples`` and twice ``FIT_DOCUMENTS`` labelled documents, chosen by
    a hash of their ids; the profiles are all that tasks carry. No shuffle.
    """
    rows = samples.select("lang", "text").filter("lang is not null and text is not null").distinct().orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(SAMPLE_ROWS).collect()
    sample = sorted({(r.lang, r.text) for r in rows})
    source = documents.select(documents[id_col].cast("bigint").alias("_id"), documents[text_col].alias("_text"), documents[label_col].alias("_label"))
    part = min(1.0, FIT_DOCUMENTS / max(1, source.count()))
    chosen = source.filter((F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))) & F.col("_label").isNotNull() & (F.length("_text") <= FIT_CHARS))
    labelled = [(r["_label"], r["_text"]) for r in chosen.orderBy(F.xxhash64("_id"), "_id", "_text").select("_label", "_text").limit(2 * FIT_DOCUMENTS).collect()]
    profiles = refit(Profiles.train(sample), sample, labelled)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(profiles)
        for f in frames:
            out: list[tuple] = []
            for doc, label, spans in zip(f["_id"].tolist(), f["_label"].tolist(), detector.spans([t if isinstance(t, str) else None for t in f["_text"]])):
                if spans:
                    label = label if isinstance(label, str) else None
                    named = label_language(label)
                    out += [(doc, seg, n, lang, round(c, 4), label, named) for seg, n, lang, c, _ in spans]
            yield pd.DataFrame(out, columns=["_id", "seg_no", "sentences", "lang", "confidence", "label", "named"])

    return spread(source).mapInPandas(run, SPANS).withColumnRenamed("_id", id_col)


def _all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_sample"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label (seg_no 0) and the stretches of documents in several languages."""
    spans = _all_spans(spark, sf_dir)
    return spans.filter("seg_no > 0 or named is null or named <> lang").select("doc_id", "seg_no", "lang")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document with a sentence and of every stretch of a mixed one."""
    return _all_spans(spark, sf_dir).select("doc_id", "seg_no", "lang", "confidence", "sentences")
