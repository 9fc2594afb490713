from collections import defaultdict

import pytest

from datasonde.llm.mixing import mix, mixing_plan, source_targets

WEIGHTS = (5, 2, 1)


def filled(sizes, weights, share=1.5, cap=2.0):
    """Targets by sharing the excess again and again."""
    left, target, open_ = share * sum(sizes.values()), {}, dict(weights)
    while open_:
        level = left / sum(open_.values())
        above = [s for s in open_ if level * open_[s] > cap * sizes[s]]
        if not above:
            return target | {s: level * w for s, w in open_.items()}
        for s in above:
            target[s] = cap * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_targets_match_resharing(spark):
    sizes = {"a": 100, "b": 5000, "c": 40, "d": 9, "e": 2500, "f": 0}
    weights = {s: WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    rows = spark.createDataFrame([(s, n, float(weights[s])) for s, n in sizes.items()], "source string, source_size long, weight double")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    assert got == pytest.approx(filled(sizes, weights))


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 7}") for i in range(3000)] + [(10_000 + i, "w " * 5, "s0") for i in range(2000)]
    plan = mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in plan.select("row.source", "row.doc_id", "size", "target", "taken", "copies").collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        most[r.source] = max(most[r.source], r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s]


def test_reruns_agree_and_copies_are_numbered(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t") for i in range(300)], "doc_id long, text string, source string")
    first, again = ({tuple(r) for r in mix(d).collect()} for d in (df.repartition(2), df.repartition(5)))
    assert first == again
    plan = {r.doc_id: r.copies for r in mixing_plan(df).select("row.doc_id", "copies").collect()}
    assert {(r[0], r[3]) for r in first} == {(i, k) for i, n in plan.items() for k in range(1, n + 1)}


def test_sources_without_words_have_no_target(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, " ", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing_plan(df).select("target", "taken").collect()} == {(0.0, 0)}


def test_odd_rows(spark, odd, none):
    plan = mixing_plan(odd)
    rows = plan.select("row.doc_id", "row.source", "size", "source_size", "taken").collect()
    assert len(rows) == odd.count()
    assert {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert {r.source_size for r in rows if r.source is None} == {1 + 1 + 6 + 15}
    out = mix(odd)
    assert out.columns == [*odd.columns, "copy_"]  # the documents have a column copy already
    assert mix(none).count() == 0 and mixing_plan(none).count() == 0
