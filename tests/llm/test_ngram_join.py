import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from datasonde.llm import ngram_join as J
from datasonde.llm.queries import QUERIES


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def set_of(text, width=5):
    words = words_of(text)
    return frozenset(" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))) if words else frozenset()


def by_hand(docs, percent=80):
    """{position: (n, component)} of (id, text) rows, over all pairs that share a shingle."""
    sets = [set_of(t) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        counts = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j > i:
                    counts[j] += 1
        for j, shared in counts.items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(docs):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return sorted(((docs[i][0], len(sets[i]), least.get(root(i)) if sets[i] else docs[i][0]) for i in range(len(docs))), key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in J.joined(df, **options).collect()), key=repr)


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "A b c D\x0be f a b c d e", "a a a a a a a a a", "É é x y z w"])
def test_shingles_are_told_apart(text):
    assert len(J.shingles(text)) == len(set_of(text))


def test_hashes_do_not_depend_on_place_or_block(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "be", "c", "delta", "x" * 50]) for _ in range(3000))
    whole = J.shingles(text)
    monkeypatch.setattr(J, "BLOCK", 64)
    assert (J.shingles(text) == whole).all()
    part = J.shingles(" ".join(words_of(text)[700:900]))
    assert np.isin(part, whole).all() and len(whole) == len(set_of(text))


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_lengths_are_exact(percent):
    for n in range(1, 200):
        assert J.probe_length(np.int64(n), percent) == n - -(-percent * n // 100) + 1
        assert J.index_length(np.int64(n), percent) == n - -(-2 * percent * n // (100 + percent)) + 1


def edited(rng, words, share):
    return [w if rng.random() > share else f"w{rng.randrange(10**6)}" for w in words]


def corpus(rng):
    """Near copies in groups, a large dense group, a passage in a third of the texts, copies, short texts."""
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, hub = text(60), text(150)
    docs = []
    for _ in range(25):
        base = text(rng.randint(8, 160))
        docs += [edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04])) for _ in range(rng.randint(1, 6))]
    docs += [edited(rng, hub, 0.015) for _ in range(120)]
    docs += [text(rng.randint(5, 90)) + passage + text(rng.randint(0, 60)) for _ in range(100)]
    docs += [passage + text(rng.randint(0, 20)) for _ in range(60)]
    docs += [text(rng.randint(1, 6)) for _ in range(30)]
    docs = [" ".join(d) for d in docs]
    docs += [rng.choice(docs) for _ in range(60)] + ["", None, " "]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"frequent": 2}), (3, {"frequent": 8, "bits": 14})])
def test_components_equal_those_of_all_pairs(spark, seed, options):
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame(docs, "id long, text string").repartition(5)
    assert found(df, **options) == by_hand(docs)


def test_a_shared_passage_and_a_dense_group_make_few_pairs(spark, monkeypatch):
    compared = []
    verified = J._verified

    def counting(docs, pairs, *rest):
        compared.append(pairs.count())
        return verified(docs, pairs, *rest)

    monkeypatch.setattr(J, "_verified", counting)
    for n in (150, 300, 600):
        rng = random.Random(n)
        passage, hub = [f"p{i}" for i in range(60)], [f"h{i}" for i in range(120)]
        text = lambda k: [f"u{rng.randrange(10**7)}" for _ in range(k)]
        docs = [text(40) + passage + text(40) for _ in range(n)] + [edited(rng, hub, 0.01) for _ in range(n)]
        df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id long, text string")
        J.joined(df, frequent=16).count()
        assert compared.pop(0) <= 16 * n and sum(compared) <= 4 * n
        compared.clear()


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, \"text\" from '{sf}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in QUERIES["op12_ngram_join"](spark, sf).collect()), key=repr)
    assert got == by_hand(docs)


def test_odd_rows(spark, odd, none):
    def rows(df):
        return df.select(F.col("doc_id").alias("id"), "text", "row", "key")

    docs = [(r.id, r.text) for r in rows(odd).collect()]
    assert found(rows(odd)) == by_hand(docs)
    assert found(rows(none)) == []
