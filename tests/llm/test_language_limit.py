"""The rejection limit and the training sample of language identification."""

from __future__ import annotations

import pickle
import random

import numpy as np

from stockflow.llm import language_id as LI


def _text(rng, letters, n=500):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n // 5))


def test_one_odd_row_does_not_set_the_limit(spark):
    rng = random.Random(4)
    rows = [(_text(rng, "abcde"), "a") for _ in range(40)] + [(_text(rng, "vwxyz"), "b") for _ in range(40)]
    model = LI.train(spark.createDataFrame(rows, "text string, lang string"))
    is_letter = LI.letters_table()
    texts = [_text(rng, "abcde") for _ in range(60)] + [_text(rng, "vwxyz") for _ in range(60)]
    langs = ["a"] * 60 + ["b"] * 60
    model.calibrate(texts, langs, is_letter)
    clean = model.most.copy()
    model.calibrate(texts + [_text(rng, "klmnopq")], langs + ["a"], is_letter)  # a mislabelled row
    assert np.allclose(model.most, clean, rtol=0.5)
    mixed = ["".join(rng.choice("abcdeklmnopq ") for _ in range(500)) for _ in range(5)]
    assert all(model.predict(mixed, is_letter)[3])
    assert sum(model.predict(texts, is_letter)[3]) == 0


def test_copies_count_once_and_the_collected_part_is_bounded(spark):
    rng = random.Random(5)
    rows = [(_text(rng, "abcde"), "a") for _ in range(60)] + [(_text(rng, "vwxyz"), "b") for _ in range(60)]
    hot = [(_text(rng, "fghij"), "a"), (_text(rng, "abfgh"), "a")]
    once = LI.train(spark.createDataFrame(rows + hot, "text string, lang string"))
    many = LI.train(spark.createDataFrame(rows + hot * 50, "text string, lang string"))
    assert np.array_equal(once.mean, many.mean) and np.array_equal(once.most, many.most)
    assert all(np.array_equal(a, b) for a, b in zip(once.logp, many.logp))
    sample = spark.createDataFrame([("x" * n, "a", k / 100, k % 2 == 0) for k, n in enumerate((900, 50, 40, 60, 30, 80, 40))]
                                   + [("y" * 99, "b", 0.5, True)], "text string, lang string, place double, cal boolean")
    got = [(r["lang"], len(r["text"])) for r in LI.calibrating(sample, 100).collect()]
    assert sorted(got) == [("a", 30), ("a", 40), ("a", 100), ("b", 99)]


def test_models_grow_with_the_sum_of_their_languages():
    rng = np.random.default_rng(7)

    def held(n):
        counts = {f"l{k:02}": np.unique(rng.integers(97, 97 + 26, (4000, 4)).astype(np.uint64)
                                        @ (np.uint64(1) << np.uint64(16) * np.arange(4, dtype=np.uint64)),
                                        return_counts=True) for k in range(n)}
        return len(pickle.dumps(LI.KneserNey(counts)))
    assert held(40) < 8.5 * held(5)
