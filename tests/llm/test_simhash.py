import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from datasonde.llm import simhash
from datasonde.llm.components import components
from pyspark.sql import functions as F


def by_hand(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    parts = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(marks):
    """Least member of each mark's component, comparing all pairs."""
    marks = sorted(set(marks))
    parent = {m: m for m in marks}

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    for a, b in combinations(marks, 2):
        if (a ^ b).bit_count() <= 4:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {m: root(m) for m in marks}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A b\u00a0c D\x0be f", "É é É x y z w", "w " * 5000 + "end"])
@pytest.mark.parametrize("width", [4, 5])
def test_fingerprints(text, width):
    assert simhash.fingerprint(text, width) & (1 << 64) - 1 == by_hand(text, width)


def test_the_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    nearest = simhash.decode(words)
    # Flipping up to three bits of a codeword decodes to the same index.
    remainders, patterns = simhash._golay()
    assert len(set(patterns.tolist())) == 2048
    codewords = words ^ patterns[[int(np.bitwise_xor.reduce(remainders[np.flatnonzero(w >> np.arange(23) & 1)])) if w else 0 for w in words]]
    for _ in range(20):
        noise = np.zeros(len(words), np.int64)
        for _ in range(3):
            noise |= 1 << rng.integers(0, 23, len(words))
        assert (simhash.decode(codewords ^ noise) == nearest).all()


@pytest.mark.parametrize("third", [False, True])
def test_marks_up_to_four_bits_apart_share_a_key(third):
    rng = np.random.default_rng(2)
    marks = rng.integers(-(2**63), 2**63 - 1, 400)
    for bits in range(5):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in marks], np.uint64).view(np.int64)
        keys = [simhash.keys_of(m, third) for m in (marks, marks ^ flips)]
        one, two = ({(r, k) for r, k in zip(*found)} for found in ((a.tolist(), b.tolist()) for a, b in keys))
        assert {r for r, _ in one & two} == set(range(len(marks)))


def clustered(n, seed):
    rng = random.Random(seed)
    marks = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        m = rng.choice(marks[-n // 2 :])
        for _ in range(rng.randint(0, 5)):
            m ^= 1 << rng.randrange(64)
        marks.append(m)
    return marks


@pytest.mark.parametrize("block", [16, simhash.BLOCK])
def test_links_connect_what_all_pairs_connect(spark, block):
    marks = clustered(100, block)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(m,) for m in sorted(set(signed))], "fp long").repartition(4)
    links = simhash.fingerprint_links(df, block=block)
    found = {r.node & (1 << 64) - 1: r.root for r in components(links).collect()}
    want = groups(marks)
    by_want, by_found = {}, {}
    for m in set(marks):
        by_want.setdefault(want[m], set()).add(m)
        by_found.setdefault(found.get(m, ("alone", m)), set()).add(m)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_found.values()))


def test_a_dense_group_gives_few_links(spark):
    base = 0x0F0F0F0F0F0F0F0F
    marks = [base ^ (1 << a) ^ (1 << b) for a, b in combinations(range(64), 2)]
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(m,) for m in signed], "fp long"))
    assert len({r.root for r in components(links).collect()}) == 1
    assert links.count() < len(marks) ** 2 / 20


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(5000, 1000 + i) for i in range(300)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000} == {got[5000]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, none):
    def rows(df):
        return df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), "text")

    found = simhash.near_duplicates(rows(odd)).collect()
    assert len(found) == odd.count()
    empty = {r.component for r in found if r.fp == 0}
    assert empty == {3}  # missing, empty and blank texts make one group
    assert simhash.near_duplicates(rows(none)).count() == 0
    left = simhash.without_near_duplicates(odd)
    assert left.columns == odd.columns
    kept = sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id != 6)
    assert [(i, t) for i, t in kept if i == 7] == [(7, "another text under the same id"), (7, "x")]
    assert [i for i, _ in kept] == [1, 2, 3, 7, 7, 8]  # the copy of 1 without an id goes
    assert simhash.without_near_duplicates(none).count() == 0
