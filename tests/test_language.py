"""Profiles of letter groups against plain counting, and what the plan moves."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from ledgerloom.operators import language

WORDS = {"aa": ["haus", "Über", "straße", "die"], "bb": ["the", "house", "of", "über"], "cc": ["дом", "это", "𝒳yz", "日本語"]}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["aa", "bb", "cc", None])
        said = [w for x in WORDS.values() for w in x] if lang is None or rng.random() < 0.3 else WORDS[lang]
        out.append((i, rng.choice([" ", "\n", " 12, ", "--"]).join(rng.choice(said) for _ in range(rng.randint(0, 40))), lang))
    return [*out, (n, None, "aa"), (n + 1, "x" * 5, "bb"), (n + 2, "1" * 50, "cc"), (n + 3, "q" * 40, None)]


def grams(text):
    flat = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    return [flat[i : i + 3] for i in range(len(flat) - 2)]


def slow(docs, groups):
    counts = {}
    for _, text, lang in docs:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    gains = {}
    for lang, c in counts.items():
        top = sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:groups]
        gains[lang] = {g: max(math.log(n / c.total()), language.FLOOR) - language.FLOOR for g, n in top}
    out = {}
    for i, text, _ in docs:
        said = grams(text) if text is not None and len(text.strip(" ")) >= language.LEAST_CHARS else []
        found = {lang: round(sum(g[x] for x in said if x in g), 6) for lang, g in gains.items() if any(x in g for x in said)}
        out[i] = min(found, key=lambda lang: (-found[lang], lang), default="unknown")
    return out


def test_languages_equal_plain_counting(spark):
    docs = corpus(200, 3)
    frame = spark.createDataFrame(docs, "id long, text string, lang string")
    got = language.detect(frame, language.fit(frame, "text", "lang", 25), "id", "text")
    assert {r["id"]: r["language"] for r in got.collect()} == slow(docs, 25)


def test_a_group_of_blanks_only_teaches_nothing(spark):
    frame = spark.createDataFrame([(1, "12 34", "aa"), (2, "", "bb")], "id long, text string, lang string")
    assert language.fit(frame, "text", "lang").collect() == []


@pytest.mark.parametrize(("dense", "piece"), [(language.DENSE, language.PIECE), (0, 100), (language.DENSE, 100)])
def test_tables_and_bisection_agree(monkeypatch, dense, piece):
    """In this process, as the limits don't reach Spark's workers."""
    monkeypatch.setattr(language, "PIECE", piece)
    monkeypatch.setattr(language, "DENSE", dense)
    docs = [(lang, " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " ") for _, text, lang in corpus(80, 5) if text and lang]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in docs]), pa.array([x for _, x in docs])], ["lang", "flat"])
    want, got = Counter(), Counter()
    for lang, flat in docs:
        want.update((lang, flat[i : i + 3]) for i in range(len(flat) - 2))
    for rows in language._count(iter([batch])):
        for r in rows.to_pylist():
            got[r["lang"], r["gram"]] += r["n"]
    assert got == want
    held = language._Profile([(lang, gram, -1.0 / n) for (lang, gram), n in want.items() if n > 1])
    assert held.dense == bool(dense)
    for start, end, codes in language._pieces(batch.column(1)):
        for (_, flat), scores in zip(docs[start:end], held.scores(codes, end - start).to_pylist(), strict=True):
            said = [flat[i : i + 3] for i in range(len(flat) - 2)]
            for lang, score in zip(held.langs, scores, strict=True):
                known = [14 - 1.0 / want[lang, g] for g in said if want[lang, g] > 1]
                assert score == (pytest.approx(sum(known)) if known else None)


def test_a_group_without_gain_is_known():
    _, _, codes = next(language._pieces(pa.array([" abc ", "xyz", None])))
    held = language._Profile([("a", "abc", language.FLOOR), ("b", "xyz", -1.0)])
    assert held.scores(codes, 3).to_pylist() == [[0.0, None], [None, 13.0], [None, None]]


def test_no_text_is_shuffled(spark):
    """i21_told_languages: a text's groups stay in the task that reads it; only counts by language are moved."""
    frame = spark.createDataFrame(corpus(20, 4), "id long, text string, lang string")
    profile = language.fit(frame, "text", "lang").cache()
    plan = language.detect(frame, profile, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    fitted = language.fit(frame, "text", "lang")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in fitted


def test_an_empty_profile_knows_nothing(spark):
    frame = spark.createDataFrame([(1, "some words that are long enough for it", None)], "id long, text string, lang string")
    got = language.detect(frame, language.fit(frame, "text", "lang"), "id", "text").collect()
    assert [tuple(r) for r in got] == [(1, "unknown")]
