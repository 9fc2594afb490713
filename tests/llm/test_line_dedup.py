import random
import re

from pyspark.sql import functions as F

from datasonde.llm.line_dedup import PIECE, _pieces, dedup_lines, without_repeats

BLANK = " \t\n\x0b\x0c\r"


def pieces(line):
    """A line with more than 16 words in pieces of 9 to 16 words up to a mark or certain letters, else of 16; all of it."""
    spans = [m.span() for m in re.finditer(r"[^ \t-\r]+", line)]
    if len(spans) <= 16:
        return [line]
    out, begin, first = [], 0, 0
    while first < len(spans):
        ends = [k for k in range(first + 8, min(first + 16, len(spans))) if line[spans[k][1] - 1] in ".!?,;:egklpu\u0430\u043a\u043b\u043f"]
        last = ends[0] if ends else min(first + 16, len(spans)) - 1
        end = spans[last + 1][0] if last + 1 < len(spans) else len(line)
        out.append(line[begin:end])
        begin, first = end, last + 1
    return out


def brute(rows):
    """(id, text) -> text without the pieces of windows that occurred before."""
    windows, cut = {}, {}
    split = {t: [(i, p) for i, line in enumerate(t.split("\n")) for p in pieces(line)] for _, t in rows if t is not None}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            continue
        solid = [(k, p.strip(BLANK)) for k, (_, p) in enumerate(split[text]) if p.strip(BLANK)]
        for p in range(max(len(solid) - 2, 1) if solid else 0):
            part = solid[p : p + 3]
            windows.setdefault(tuple(s for _, s in part), []).append((doc, text, part[0][0], part[-1][0]))
    for places in windows.values():
        first = (places[0][0], places[0][1], places[0][2])
        for doc, text, a, b in places:
            if (doc, text, a) != first:
                cut.setdefault((doc, text), set()).update(range(a, b + 1))

    def rest(doc, text):
        lines = {}
        for k, (i, p) in enumerate(split[text]):
            if k not in cut[doc, text]:
                lines[i] = lines.get(i, "") + p
        return "\n".join(lines.values())

    return [(d, t if t is None or (d, t) not in cut else rest(d, t)) for d, t in rows]


def run(spark, rows):
    df = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return sorted(map(tuple, df.collect()), key=repr)


def test_random_texts_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", " d", "", "e f", "a "]) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_passages_within_long_lines_match_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeinst") for _ in range(rng.randint(1, 6))) + rng.choice(["", "", "", ",", "."])
    shared = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(8)]
    some = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    part = lambda: rng.choice([some(40), rng.choice(shared), rng.choice(shared) + rng.choice([" ", "  ", "\t"]) + some(9)])
    rows = [(i, "\n".join(rng.choice(["", " "]) + some(12) + " " + part() for _ in range(rng.randint(0, 5)))) for i in range(80)]
    want = brute(rows)
    assert run(spark, rows) == sorted(want, key=repr)
    assert sum(a != b for a, b in zip(rows, want)) > 40


def test_a_long_line_in_many_documents_stays_once(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdefghilmnoprstu") for _ in range(6))
    line = " ".join(word() for _ in range(80))
    own = [[" ".join(word() for _ in range(30)) for _ in range(6)] for _ in range(5)]
    whole = [(i, "\n".join([*own[i][:3], line, *own[i][3:]])) for i in range(5)]
    got = dict(run(spark, whole))
    assert got[0] == whole[0][1]
    assert all(got[i] == "\n".join(own[i]) for i in range(1, 5))
    inside = [(i, "\n".join([own[i][0] + " " + line + " " + own[i][1], *own[i][2:]])) for i in range(5)]
    got = dict(run(spark, inside))
    left = [len(set(line.split()) & set(got[i].split())) for i in range(5)]
    assert left[0] == 80 and max(left[1:]) <= 45  # what comes before the first cut that both share, and the last piece
    assert all(set(" ".join(own[i]).split()) <= set(got[i].split()) for i in range(5))


def test_first_text_of_a_line_stays(spark):
    rows = [(1, "A\nA\nA\nA\nA"), (2, "x\ny\nz\nw"), (3, "q\nx\ny\nz\nr")]
    assert run(spark, rows) == [(1, "A"), (2, "x\ny\nz\nw"), (3, "q\nr")]


def test_short_documents_are_one_window(spark):
    rows = [(1, "only line"), (2, "only line"), (3, "two\nlines"), (4, " two \n\nlines"), (5, "two")]
    assert run(spark, rows) == [(1, "only line"), (2, ""), (3, "two\nlines"), (4, ""), (5, "two")]


def test_odd_rows(spark, odd, none):
    out = dedup_lines(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(brute(rows), key=repr)
    changed = {r.doc_id: r for r in out.collect() if r.doc_id in (1, 2)}
    assert changed[1].text == "" and changed[1].n_chars == 0  # the row without an id sorts first
    assert changed[2].text == "something else" and changed[2].n_chars == 14
    assert dedup_lines(none).count() == 0
    assert without_repeats(none).count() == 0


def test_no_python_in_the_plan(spark, odd):
    plan = dedup_lines(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_text_is_cut_once_for_each_use(spark, odd):
    # The windows to count, the windows to compare, and the texts to change; a filter on what is cut would cut again.
    plan = without_repeats(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(PIECE) == 3


def test_pieces_of_lines_with_odd_words_and_spaces(spark):
    rng = random.Random(8)
    ends = [*"egklpu.,;:!?", *"abdz9)", "\u0430", "\u043b", "\u0436", "\xe9", "\u4e2d", "\U0001f600", "\xa0", "\x85", "\u2003", "e.", "\u0430\u0301"]
    word = lambda: "".join(rng.choice("abcdfhij\u0431\xa0") for _ in range(rng.randint(0, 3))) + rng.choice(ends)
    space = lambda: "".join(rng.choice(BLANK) for _ in range(rng.choice([1, 1, 1, 2, 3])))
    line = lambda n: rng.choice(["", space()]) + "".join(word() + space() for _ in range(n - 1)) + word() * (n > 0) + rng.choice(["", space()])
    texts = ["\n".join(line(rng.choice([0, 1, 7, 8, 9, 15, 16, 17, 18, 24, 25, 33, rng.randint(0, 70)])) for _ in range(6)) for _ in range(300)]
    texts += ["", " ", "\n", "x" * 40000, "b " * 5000, "e " * 5000 + "\t" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(p) for p in r.pieces] for r in df.select("doc_id", _pieces(F.col("text")).alias("pieces")).collect()}
    assert got == {k: [(i, p) for i, line in enumerate(t.split("\n")) for p in pieces(line)] for k, t in enumerate(texts)}
    counted = {r.doc_id: r.n_lines for r in without_repeats(df).select("row.doc_id", "n_lines").collect()}
    assert counted == {k: sum(x.strip(BLANK) != "" for x in t.split("\n")) for k, t in enumerate(texts)}
