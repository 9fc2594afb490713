import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from datasonde.llm.decontaminate import contamination, decontaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    out = []
    for doc, text in docs:
        have, hit, names = words(text), set(), set()
        for name, body in items:
            want = words(body)
            for p in range(max(len(want) - width + 1, 1) if want else 0):
                part = want[p : p + width]
                for i in range(len(have) - len(part) + 1):
                    if have[i : i + len(part)] == part:
                        hit.update(range(i, i + len(part)))
                        names.add("null" if name is None else str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(have), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, width):
    d = spark.createDataFrame(docs, "id long, text string").withColumn("digest", F.xxhash64("text")).repartition(3)
    rows = contamination(d, spark.createDataFrame(items, "item long, text string"), width)
    return sorted(map(tuple, rows.drop("digest").collect()), key=repr)


@pytest.mark.parametrize("width", [3, 10])
def test_random_texts_match_brute_force(spark, width):
    rng = random.Random(width)
    pool = ["a", "b", "Ab", "é", "x1", "c,d"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    items = [(i, text(14)) for i in range(12)]
    docs = [(i, text(40)) for i in range(60)] + [(100 + i, f"{text(9)} {b}! {text(9)}") for i, b in items]
    assert run(spark, docs, items, width) == brute(docs, items, width)


def test_short_repeated_and_missing_items(spark):
    items = [(1, "short item"), (2, "Short, ITEM"), (3, None), (4, "..."), (None, "of no id"), (2, "Short, ITEM")]
    docs = [(1, "a short item here"), (2, "short short item item"), (3, None), (4, ""), (5, "shortitem"), (6, "of no id"), (None, "short item"), (6, "of no id")]
    assert run(spark, docs, items, 10) == brute(docs, items, 10)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([("q", "the long text has line 4000 of many and says 16000000 there")], "item_id string, text string")
    out = decontaminated(odd, items)
    assert out.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 7, 7, 8]
    assert decontaminated(none, items).count() == 0
    assert decontaminated(odd, items.filter("false")).count() == odd.count()
