import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from datasonde.llm import filter_audit as A


def failed(text, body_ids, name):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    out = set()
    out |= {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
    out |= {"D"} if set(text) & set("#$%&*|") else set()
    known = [i for i in body_ids[text] if i is not None]
    out |= {"E"} if name is not None and min(known) < name else set()
    return out


def by_hand(docs, labels):
    """Every row of the audit from (id, part, text) and (id, quality, toxic), document by document."""
    bodies = {}
    for i, _, t in docs:
        bodies.setdefault(t or "", []).append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}  # a missing id has no label
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows, parts = [], {p or "" for _, p, _ in docs}
    judged = [(i, p or "", failed(t, bodies, i)) for i, p, t in docs]
    for part in parts:
        own = [(i, f) for i, p, f in judged if p == part]
        removed = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if letter in f]
                redundant = sum(letter in f for _, f in own) - len(gone)
                left = [(i, f) for i, f in left if letter not in f]
                removed[letter] += len(gone)
                unique = sum(f == {letter} for _, f in own)
                rows.append([part, order, step, len(left), len(gone), redundant, unique, sum(i in good for i in gone), sum(i in toxic for i in gone)])
        for row in rows:
            if row[0] == part:
                row.append(removed[row[1][row[2] - 1]])
    return sorted(map(tuple, rows))


def found(spark, docs, labels):
    d = spark.createDataFrame(docs, "id long, part string, text string").repartition(3)
    return sorted(map(tuple, A.filter_audit(d, spark.createDataFrame(labels, "id long, quality int, toxic int")).collect()))


def test_audit_equals_walking_every_order(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "#tag", "GO", "x"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 40, 306])]) for _ in range(rng.choice([3, 150, 199, 200, 260]))) for _ in range(25)] + ["", None, "A", " \n"]
    docs = [(i, rng.choice(["en", "fr", None, ""]), rng.choice(texts)) for i in range(90)]
    docs += [(3, "en", "one id"), (3, "de", "one id"), (None, "en", "one id"), (None, None, None), (5, "en", "one id")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 0, 0), (4, 1, 0), (None, 1, 1), (999, 1, 1)]
    assert found(spark, docs, labels) == by_hand(docs, labels)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0)], "id long, quality int, toxic int")

    def rows(df):
        return df.select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), "text", "row", "size")

    docs = [(r.id, r.part, r.text) for r in rows(odd).collect()]
    assert sorted(map(tuple, A.filter_audit(rows(odd), labels).collect())) == by_hand(docs, [(1, 1, 0)])
    assert A.filter_audit(rows(none), labels).count() == 0
    assert A.filter_audit(rows(odd), labels.filter("false")).count() == 600 * len({p or "" for _, p, _ in docs})


@pytest.mark.parametrize("letters", ["A", "AB", "ABC"])
def test_any_number_of_filters(spark, letters):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 1)], "part string, mask int, n long, good long, toxic long")
    rows = A.audit(cells, letters).collect()
    assert len(rows) == len(list(permutations(letters))) * len(letters)
    assert all(r.kept == (5 if "A" in r.filter_order[: r.step] else 8) for r in rows)
