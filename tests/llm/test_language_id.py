import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from datasonde.llm import language_id as lid
from datasonde.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SYLLABLES = {"aa": "ka lo mi ru ta", "bb": "xo zi qu ge py", "cc": "éa ßo ün øl ñi"}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = [(lang, text(lang, 80, rng)) for lang in SYLLABLES for _ in range(20)] + [(None, "never learned"), ("aa", None)]
    return lid.fit_languages(spark.createDataFrame(rows, "lang string, text string").repartition(3))


def slow_cells(text):
    """All n-grams of words with a space on both sides, without those whose middle is a space."""
    plain = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " ".join(plain.split(" ")).strip()
    grams = []
    for word in plain.split():
        padded = f" {word} "
        grams += [g for n in lid.GRAMS for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g[n // 2] != " "]
    return grams


@pytest.mark.parametrize("body", ["a", "Ab cd", "x1y  zé!", " trailing. ", "\U00010400 deseret"])
def test_grams_are_those_within_words(body):
    assert len(lid.gram_cells(body)) == len(slow_cells(body))
    assert sorted(lid.gram_cells(body).tolist()) == sorted(lid.gram_cells(f"  {body.upper().lower()}  ").tolist())


def test_counts_over_pieces_add_up():
    body = "some words " * 5000
    cells, counts = lid.count_cells(body)
    want, wanted = np.unique(lid.gram_cells(body), return_counts=True)
    assert (cells == want).all() and abs(counts - wanted).max() <= 4


def test_one_language(model):
    rng = random.Random(4)
    for lang in SYLLABLES:
        assert model.predict(text(lang, 30, rng)) == (lang, 1.0)


@pytest.mark.parametrize("share", [0.25, 0.4, 0.7])
def test_mixtures_are_proportions(model, share):
    rng = random.Random(5)
    n = 400
    body = text("bb", int(n * share), rng) + " " + text("cc", n - int(n * share), rng)
    lang, score = model.predict(body)
    assert lang == ("bb" if share > 0.5 else "cc") and score == pytest.approx(max(share, 1 - share), abs=0.06)


def test_each_step_of_the_fit_raises_the_likelihood(model):
    rng = random.Random(6)
    cells, counts = lid.count_cells(text("aa", 50, rng) + " " + text("cc", 70, rng))
    p = model.likelihood[cells]
    share, seen = np.full(3, 1 / 3), -np.inf
    for _ in range(10):
        now = float(counts @ np.log(p @ share))
        assert now >= seen - 1e-9
        seen = now
        share = share * ((counts / (p @ share)) @ p) / counts.sum()


def test_odd_rows(spark, odd, none, model):
    rows = odd.select(F.col("doc_id").alias("id"), "text")
    got = [(r.id, r.lang_pred, r.score) for r in lid.predict_languages(rows, model).collect()]
    assert len(got) == odd.count()
    assert {(lang, s) for i, lang, s in got if i in (3, 4, 5)} == {("und", 0.0)}
    assert all(0 <= s <= 1 for _, _, s in got)
    assert lid.predict_languages(none.select(F.col("doc_id").alias("id"), "text"), model).count() == 0
    empty = lid.fit_languages(none.select("lang", "text"))
    assert {r.lang_pred for r in lid.predict_languages(rows, empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_pieces_count_as_the_whole_text():
    text = "ab\u00e9 \u039f\u0394\u039f\u03a3 xyz, q7r\n" * 120_000 + "y" * 1_100_000 + " end"
    whole, counts = np.unique(lid.gram_cells(text), return_counts=True)
    cells, found = lid.count_cells(text)
    assert (cells == whole).all() and (found == counts).all()
