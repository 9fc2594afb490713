import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from datasonde.llm import pu_quality as pu
from datasonde.llm import quality_rules as rules
from datasonde.llm.boosting import fit_trees
from datasonde.llm.queries import QUERIES
from datasonde.llm.text_stats import BASE, SHAPE, measure

SF = "/root/testdata/sf0.01"


def by_hand(text):
    """The base counts, word by word and window by window."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def random_text(rng):
    pool = rng.choice([["a", "b"], ["a", "é#", "ñ|", "\U0001f600", "c"], [f"w{i}" for i in range(40)]])
    return "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "\t ", " "]) for _ in range(rng.randint(0, 120)))


def test_base_counts_match_brute_force():
    rng = random.Random(9)
    for text in [None, "", " \n", "a", "a " * 8, "a " * 9, *(random_text(rng) for _ in range(300))]:
        assert measure(text)[0] == by_hand(text), text


def test_shapes_are_finite_for_any_text():
    for text in ("", " ", "x" * 100_000, "é" * 3, "| " * 5000):
        assert len(measure(text)[1]) == len(SHAPE) and np.isfinite(measure(text)[1]).all()


def test_flat_trees_fit_and_keep_their_constraints():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] + np.sin(3 * x[:, 1]) + 0.3 * rng.normal(size=4000)) > 0).astype(float)
    model = fit_trees(x, y, {0: 1, 2: -1})
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.9
    grid = np.repeat(rng.normal(size=(50, 1, 3)), 60, axis=1)
    for feature, way in ((0, 1), (2, -1)):
        moved = grid.copy()
        moved[:, :, feature] = np.linspace(-4, 4, 60)
        steps = np.diff(model.margin(moved.reshape(-1, 3)).reshape(50, 60), axis=1)
        assert (way * steps >= -1e-12).all()


def test_trees_without_rows_or_with_one_label():
    x = np.zeros((0, 2))
    assert fit_trees(x, np.zeros(0)).probability(np.ones((3, 2))).tolist() == [0.5] * 3
    assert (fit_trees(np.ones((30, 2)), np.ones(30)).probability(np.ones((3, 2))) > 0.9).all()


def test_the_prior_and_the_classifier_without_negatives():
    rng = np.random.default_rng(12)
    good = lambda n: rng.normal([1, 0, 0], 0.6, (n, 3))
    bad = lambda n: rng.normal([-2, 1, 0], 0.6, (n, 3))
    for share in (0.4, 0.8):
        unlabelled = rng.permutation(np.vstack([good(int(3000 * share)), bad(3000 - int(3000 * share))]))
        model = pu.fit_matrices(good(1500), unlabelled)
        assert model.prior == pytest.approx(share, abs=0.08)
        assert (model.net.probability(good(500)) >= 0.5).mean() > 0.95 and (model.net.probability(bad(500)) < 0.3).mean() > 0.9


def test_odd_rows(spark, odd, none):
    rows = odd.select(F.col("doc_id").alias("id"), "text")
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (None, 1), (3, 0), (99, 1), (2, None)], "id long, label int")
    out = rules.apply_rules(odd, labels).collect()
    assert len(out) == odd.count() and all(r.base_failed and not r.kept for r in out if r.n_words < 20)
    assert sorted([r.id or 0, *(r[c] for c in BASE)] for r in out) == sorted([r.id or 0, *by_hand(r.text)] for r in rows.collect())
    assert rules.apply_rules(none, labels).count() == 0 and rules.apply_rules(odd, labels.filter("false")).count() == odd.count()
    for positives in (labels.filter("label = 1"), labels.filter("false")):
        model = pu.fit_quality(rows, positives, F.lit(True))
        got = [(r.id, r.score) for r in pu.score_quality(rows, model).collect()]
        assert len(got) == odd.count() and all(0 <= s <= 1 for _, s in got) and {s for i, s in got if i in (3, 4, 5)} == {0.0}
        assert pu.score_quality(none.select(F.col("doc_id").alias("id"), "text"), model).count() == 0
        assert odd.filter(pu.quality_score(model)(F.col("text")) >= 0).count() == odd.count()


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op5_quality_classifier"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_rules_on_the_given_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op6_quality_rules"](spark, SF).collect()
    for r in rows:
        counts = by_hand(docs[r.doc_id])
        assert [r[c] for c in BASE] == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and not (r.kept and r.base_failed)
    known = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(k == q for k, q in known) >= 0.97 * len(known)
