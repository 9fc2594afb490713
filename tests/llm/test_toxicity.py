import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from datasonde.llm import toxicity as tox
from datasonde.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
MODEL = tox.ToxicModel({"fool": 4.0, "wretch": 2.0}, {"vile": 3.0})
READ = MODEL.reader()
ONE = dict(zip(tox.FEATURES, range(len(tox.FEATURES))))


def strongest(text):
    return READ(text)[ONE["strongest"]]


def test_clauses_are_scored_in_their_context():
    assert strongest("a fool") == 4.0
    assert strongest("you fool") == 6.0  # addressed
    assert strongest("not a fool") == pytest.approx(1.2)
    assert strongest("not one of many a fool") == 4.0  # out of the negation's reach
    assert strongest("said a fool") == 2.0
    assert strongest("said so. a fool") == 4.0  # the report ends with its clause
    assert strongest("a fool wretch") == 6.0 and strongest("a fool. a wretch") == 4.0
    assert strongest("vileness") == 3.0 and strongest("vile") == 0.0  # a beginning needs an ending
    assert strongest("FOOL!") == 4.0


def test_threats_count_by_clause():
    threat = ONE["threat"]
    assert READ("they will hurt")[threat] == pytest.approx(np.log1p(0.75))
    assert READ("it will hurt")[threat] == pytest.approx(np.log1p(0.5))
    assert READ("never hurt you")[threat] < READ("hurt you")[threat]


def test_the_composition_equals_its_parts_run_side_by_side():
    parts, factors = [tox.negation(), tox.within_clause(tox.REPORT), tox.within_clause(tox.TARGET)], [0.3, 0.5, 1.5]
    machine = tox.grammar()
    for symbols in product(range(tox.END + 1), repeat=4):
        states, state = [0, 0, 0], 0
        for symbol in symbols:
            steps = [p.step(s, symbol) for p, s in zip(parts, states)]
            weight = {tox.INSULT: 1.0, tox.THREAT: 0.5}.get(symbol, 0.0) * np.prod([f if m else 1 for f, (_, m) in zip(factors, steps)])
            assert machine.weight[state, symbol] == pytest.approx(weight)
            states, state = [s for s, _ in steps], machine.next[state, symbol]


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ba du ko ri te mi lu".split()) for _ in range(3))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["grub", "snide", "zzorb" + word(), "zzorb" + word()]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000 + k, "copied " + rows[0][1]) for k in range(30)]
    labels += [(1000 + k, 1) for k in range(30)] + [(5, None), (None, 1)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    return docs, tox.fit_toxicity(docs, spark.createDataFrame(labels, "id long, label int"))


def test_insults_are_learned_but_not_what_copies_share(learned):
    docs, model = learned
    assert {"grub", "snide"} <= set(model.terms) and "zzorb" in model.beginnings
    assert "copied" not in model.terms
    rows = {r.id: r.score for r in tox.score_toxicity(docs, model).collect()}
    assert all((rows[i] >= 0.7) == (i % 4 == 0) for i in range(400))


def test_odd_rows(spark, odd, none, learned):
    rows = odd.select(F.col("doc_id").alias("id"), "text")
    got = [(r.id, r.score) for r in tox.score_toxicity(rows, learned[1]).collect()]
    assert len(got) == odd.count() and all(0 <= s < 0.5 for _, s in got)
    labels = spark.createDataFrame([], "id long, label int")
    bare = tox.fit_toxicity(rows, labels)
    assert not bare.terms
    assert tox.score_toxicity(none.select(F.col("doc_id").alias("id"), "text"), bare).count() == 0
    one_kind = tox.fit_toxicity(rows, spark.createDataFrame([(1, 1), (3, 1), (4, 1), (7, 1)], "id long, label int"))
    assert tox.score_toxicity(rows, one_kind).count() == odd.count()


def test_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in held) >= 0.93 * len(held)
    assert sum(p for p, t in held if t) >= 0.7 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.03 * len(held)
