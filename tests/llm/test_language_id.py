"""Language identification: counts against brute force, the order of backing off, held-out accuracy, odd rows."""

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, word string, n long, score long, lang_pred string, k0 string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, 2, "z", "k") for r in rows], SCHEMA).repartition(3)


TEXTS = [("a", "the cat the dog"), ("a", "the bird"), ("b", "der hund der Hund"), ("b", "eine katze"), (None, "ignored words"), ("b", None), ("a", "")]


def test_counts_against_brute_force(spark):
    model = li.train(frame(spark, [(i, t, lang) for i, (lang, t) in enumerate(TEXTS)]))
    assert model.langs == ["a", "b"]
    words, grams = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, t in TEXTS:
        if lang and t:
            for w in t.lower().split():
                words[lang][w] += 1
                for n in range(1, li.GRAM + 1):
                    grams[lang, n].update(g for g in li.grams_of(w, n) if g != " ")
    for i, lang in enumerate(model.langs):
        for w, at in model.words.items():
            want = np.log(words[lang][w] / sum(words[lang].values())) if words[lang][w] else np.log(1 / 6) - li.PENALTY
            assert abs(model.word_scores[at, i] - want) < 1e-5
        for g, at in model.grams.items():
            if n := grams[lang, len(g)][g]:
                assert abs(model.gram_scores[at, i] - np.log(n / sum(grams[lang, len(g)].values()))) < 1e-5


def test_backing_off():
    grams = [("abc", "x", 1, 10), ("bc ", "y", 1, 10), ("b", "x", 5, 10), ("q", "y", 1, 10)]
    model = li.Model(["x", "y"], [("word", "x", 1, 2)], grams)
    both = model.gram_scores[[model.grams["abc"], model.grams["bc "]]].mean(0)
    assert np.allclose(model.back_off("abc"), both)  # the longest length with a known n-gram, its known ones only
    assert np.allclose(model.back_off("zbz"), model.gram_scores[model.grams["b"]])
    assert np.allclose(model.back_off("zzz"), 0)
    assert model.predict("WORD")[0] == "x" and model.predict("q")[0] == "y"
    assert model.predict("zzz zzz") == ("x", 0.5)  # nothing is known: the first by name
    assert model.predict("12 ...") == ("und", 0.0) and model.predict(None) == ("und", 0.0)
    one = model.predict("word " * 10_000 + "q")
    assert one[0] == "x" and 0 <= one[1] <= 1


def test_long_runs_and_bounds(spark, monkeypatch):
    assert li.words_of("é" * 200 + " b") == {"é" * 64: 3, "é" * 8: 1, "b": 1}
    monkeypatch.setattr(li, "MOST_WORDS", 4)
    monkeypatch.setattr(li, "MOST_GRAMS", 6)
    monkeypatch.setattr(li, "MOST_LANGUAGES", 2)
    monkeypatch.setattr(li, "HELD", 3)
    rows = [(i, t, lang) for i, (lang, t) in enumerate(TEXTS)] + [(50, "rare", "c")]
    model = li.train(frame(spark, rows))
    assert model.langs == ["a", "b"] and set(model.words) == {"the", "der", "hund"}
    by = collections.Counter(map(len, model.grams))
    assert all(n <= 6 for n in by.values())


def test_odd_rows(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(TEXTS * 3)] + [(None, "the dog", "a"), (None, None, None), (5, "x" * 300_000, "a"), (5, "the " * 100_000, "b"), (5, "\x00 ퟿", None)]
    docs = frame(spark, rows)
    model = li.train(docs.where(li.fold("doc_id", 3) != 1))
    out = li.identify(docs, model, keep=("doc_id", "k0")).collect()
    assert len(out) == len(rows) and {r["k0"] for r in out} == {"k"}
    assert all(0 <= r["score"] <= 1 for r in out) and {r["lang_pred"] for r in out} <= {"a", "b", "und"}
    assert sum(r["lang_pred"] == "und" for r in out) == sum(not any(c.isalpha() for c in r[1] or "") for r in rows)
    nothing = li.train(frame(spark, []))
    assert nothing.langs == [] and {r["lang_pred"] for r in li.identify(docs, nothing, keep=("doc_id",)).collect()} == {"und"}
    assert li.identify(frame(spark, []), model, keep=("doc_id",)).count() == 0


def test_held_out_rows_teach_nothing(spark, data):
    out = li.op11_language_id(spark, data)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = out.collect()
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.98 * len(held)
    folded = spark.createDataFrame([(1,), (None,)], "doc_id long").select(li.fold("doc_id", 3).alias("f"), F.lit(1)).collect()
    assert folded[0]["f"] == zlib.crc32(b"1") % 3 and folded[1]["f"] is None
