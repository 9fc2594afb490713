import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest

from datasonde.llm import conversation_repair as R
from datasonde.llm.queries import QUERIES

SCHEMA = "conv long, turn long, role string, text string, n long"
SPACE = "\t\n\x0b\x0c\r "


def judged(rows):
    """(role, text, blank, again, open) of (role, text) rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append((role, text, not bare, (role, text) in seen, bare[-1:] not in (".", "!", "?")))
        seen.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, body) of all repairs with at most two inserts in a row, by plain enumeration."""

    def onward(i, cost, audit, body, inserts):
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in body)) and i == len(rows):
            yield cost, audit, "\n".join(f"{r}:{t}" for r, t in body)
        if inserts < 2:
            for role in ("user", "assistant"):
                yield from onward(i, cost + 3, audit + "I", [*body, (role, "")], inserts + 1)
        if i < len(rows):
            role, text, blank, again, open_ = rows[i]
            yield from onward(i + 1, cost + 4, audit + "D", body, 0)
            if not blank and not again:
                yield from onward(i + 1, cost + 3 * open_, audit + "K", [*body, (role, text)], 0)
                for other in ("user", "assistant"):
                    yield from onward(i + 1, cost + 3 + 3 * open_, audit + "R", [*body, (other, text)], 0)

    return onward(0, 0, "", [], 0)


def plain_repair(rows):
    """(cost, audit, body) with whole strings, state by state."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def filled(best):
        for _ in range(2):
            for state, (cost, audit, body) in list(best.items()):
                new = (cost + 3, audit + "I", [*body, names[due[state]] + ":"])
                if due[state] not in best or new[:2] < best[due[state]][:2]:
                    best[due[state]] = new
        return best

    best = filled({"": (0, "", [])})
    for role, text, blank, again, open_ in rows:
        after = {}

        def offer(state, cost, audit, body):
            if state not in after or (cost, audit) < after[state][:2]:
                after[state] = (cost, audit, body)

        for state, (cost, audit, body) in best.items():
            offer(state, cost + 4, audit + "D", body)
            if not blank and not again:
                if role[:1] == due[state] or (role[:1] == "s" and state == ""):
                    offer(role[:1], cost + 3 * open_, audit + "K", [*body, f"{role}:{text}"])
                offer(due[state], cost + 3 + 3 * open_, audit + "R", [*body, f"{names[due[state]]}:{text}"])
        best = filled(after)
    cost, audit, body = min(best[s] for s in ("", "a") if s in best)
    return cost, audit, "\n".join(body)


def conversation(rng, length):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", ""], ["Yes.", "No!", "open end", "", " ", "Why?", "so be it."]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(length)]


def test_plain_programme_equals_enumeration():
    rng = random.Random(1)
    for _ in range(60):
        rows = judged(conversation(rng, rng.randint(0, 4)))
        cost, audit, body = min(every_repair(rows))
        assert plain_repair(rows) == (cost, audit, body)


def test_tree_orders_strings():
    rng = random.Random(2)
    tree = R.AuditTree()
    nodes = [0]
    for _ in range(600):
        nodes.append(tree.add(rng.choice(nodes[-6:]), rng.choice("DIKR")))
    for _ in range(3000):
        x, y = rng.choice(nodes), rng.choice(nodes)
        assert tree.less(x, y) == (tree.text(x) < tree.text(y))
    deep = nodes[-1]
    assert all(tree.text(tree.ancestor(deep, d)) == tree.text(deep)[:d] for d in range(tree.depths[deep] + 1))


def test_tree_verifies_equal_hashes():
    tree = R.AuditTree()
    x, y = tree.add(tree.add(0, "D"), "K"), tree.add(tree.add(0, "I"), "D")
    tree.hashes[x] = tree.hashes[y] = 1
    assert tree.less(x, y) and not tree.less(y, x)


def check(spark, convs, piece_bits=R.PIECE_BITS, fold=False):
    rows = [(c, t, role, text, 1) for c, found in convs.items() for t, (role, text) in enumerate(found)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = R.repair(df, piece_bits)
    got = {r.conv: r for r in found.conversations.collect()}
    bodies = {}
    for r in found.rows.orderBy("at", "place").collect():
        bodies.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    hashes = {r.conv: r.sha256 for r in R.digests(found.rows).collect()}
    assert set(got) == {c for c, rows in convs.items() if rows}
    for c, r in got.items():
        marked = judged(convs[c])
        cost, audit, body = plain_repair(marked)
        assert (r.cost, r.audit, "\n".join(bodies.get(c, []))) == (cost, audit, body)
        assert hashes.get(c) == (sha256(body.encode()).hexdigest() if c in bodies else None)
        initials = [m[0][:1] for m in marked]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert r.blank == sum(m[2] for m in marked)
        assert r.duplicate == sum(m[3] and not m[2] for m in marked)
        assert r.truncated == sum(m[4] and not m[2] and not m[3] for m in marked)


@pytest.mark.parametrize("piece_bits", [0, 2, R.PIECE_BITS])
def test_repair_equals_the_plain_programme(spark, piece_bits):
    rng = random.Random(3)
    convs = {c: conversation(rng, rng.randint(0, 12)) for c in range(120)}
    convs[500] = conversation(rng, 400)  # one conversation of a third of all rows
    check(spark, convs, piece_bits)


def test_long_conversation_of_distinct_texts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["user", "assistant", "system"]), f"line {i}" + rng.choice([".", ""])) for i in range(700)]
    check(spark, {1: rows, 2: rows[:5]}, 3)


def test_equal_rows_of_a_turn_are_folded(spark):
    rows = [(1, 0, "user", "Hello.", 3), (1, 1, "assistant", "Hi.", 1), (1, 1, "assistant", "Hi.", 2), (1, 5, "user", "", 4), (None, None, "user", "a.", 1), (None, 2, None, None, 1)]
    got = {r.conv: r for r in R.repair(spark.createDataFrame(rows, SCHEMA)).conversations.collect()}
    assert (got[1].audit, got[1].cost, got[1].duplicate, got[1].blank) == ("KDDKDDDDDD", 32, 4, 4)
    assert (got[1].gaps, got[1].illegal) == (3, 2 + 2 + 3)
    assert (got[None].audit, got[None].gaps, got[None].blank) == ("KDI", 0, 1)


def expected(rows):
    """The query's rows from (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held = out.setdefault(conv, [])
        if mark == 0:
            continue
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        held += [(turn is not None, turn, "user" if mark == 4 else role, text)] * (2 if mark == 3 else 1)
    result = {}
    for conv, held in out.items():
        held.sort(key=lambda r: r[:2] if r[0] else (False, 0))
        marked = judged([r[2:] for r in held])
        cost, audit, body = plain_repair(marked) if marked else (0, "", "")
        turns = [r[1] for r in held if r[0]]
        initials = [m[0][:1] for m in marked]
        result[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            sum(m[2] for m in marked),
            sum(m[3] and not m[2] for m in marked),
            sum(m[4] and not m[2] and not m[3] for m in marked),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            sha256(body.encode()).hexdigest(),
        )
    return result


def test_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select conv_id, turn, role, \"text\" from '{sf}/conversations.parquet'").fetchall()
    want = expected(rows)
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op13_conversation_repair"](spark, sf).collect()}
    assert got == want
    assert sum(r[5] for r in want.values()) > 0


def test_the_query_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None), (1, 0, "user", "x" * 300_000), (1, 1, "", "?"), (2, 7, "user", "Bye."), (None, 3, "user", "Hm."), (None, None, None, ""), (4, 2, "assistant", " ")]
    rows += [(c, t, "user", "ok.") for c in range(10, 30) for t in range(3)]
    columns = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "extra") for r in rows], columns + ", n string")
    df.write.parquet(f"{tmp_path}/some/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op13_conversation_repair"](spark, f"{tmp_path}/some").collect()}
    assert got == expected(rows)
    df.filter("false").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["op13_conversation_repair"](spark, f"{tmp_path}/none").count() == 0
