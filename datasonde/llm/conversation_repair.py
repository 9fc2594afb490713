"""Repair of conversations by the cheapest edits, with the edits as an audit string.

A conversation is good if the initials of its roles are ``(s?(ua)+)?``. Its rows, by turn, are
kept (K, cost 0), given the role that is due (R, 3) or deleted (D, 4; the only way for a blank
row and for one whose role and text were there before); rows without text are inserted (I, 3)
anywhere, and a truncated row that isn't deleted costs 3 more. Of the cheapest edits those with
the least audit string are taken. Edits fix the roles, as only a kept row can be the leading s.

The dynamic programme has four states (nothing yet, after s, after u, after a) and keeps the
cheapest audit of each. Audits share their prefixes as linked nodes, each with binary-lifting
ancestors and a rolling hash. Two audits of one cost and state are compared by a search for
their longest common prefix; equal hashes are verified letter by letter down to a shared node.
Neither is a prefix of the other, as the same rows with further inserts would cost more, so the
lesser stays the lesser whatever follows.

Nothing needs a conversation as a whole. Equal rows (conversation, turn, role, text) are folded
to one with their number, and the narrow rows, without texts, are range-sorted and numbered over
all conversations, so that a long conversation spans many tasks. Numbers are cut in pieces of
2^``PIECE_BITS`` rows, and a piece gives, for each conversation in it, the cheapest audit from each
state to each state. Pieces of one conversation are then composed in their order, one after the
other; what all open audits have in common is settled at once, and what grows with a
conversation is its audit alone, which is one cell of the result by contract. The pieces' own
audits tell what happens to each row, and texts join the rows that stay.

A missing role or text is one space; a missing conversation id is one conversation, a missing
turn sorts first. Rows of one turn are ordered by a hash of role and text. Empty conversations,
those whose rows are all deleted, and empty tables are fine. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasonde.functions.shared import stored
from datasonde.functions.values import grouped
from datasonde.llm.columns import ASCII_SPACE

PIECE_BITS = 14
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States: nothing yet, after the leading s, after u, after a.
START, S, U, A = range(4)
ENDS = (START, A)
KEEPS = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
LEGAL = {"su", "ua", "au"}
# A kept leading s has a letter of its own inside; it competes with no other kept row and sorts like K.
LEAD = "L"
MODULUS, BASE = (1 << 61) - 1, 1_000_003


def due(state: int) -> int:
    """The state after a row with the role that is due: user, or assistant after a user."""
    return A if state == U else U


class AuditTree:
    """Audit strings as nodes of a tree; node 0 is the empty string."""

    def __init__(self) -> None:
        self.letters, self.depths, self.hashes, self.up = [""], [0], [0], [[0]]

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letters)
        up, k = [parent], 0
        while k < len(self.up[up[k]]) and up[k]:
            up.append(self.up[up[k]][k])
            k += 1
        self.letters.append(letter)
        self.depths.append(self.depths[parent] + 1)
        self.hashes.append((self.hashes[parent] * BASE + ord(letter)) % MODULUS)
        self.up.append(up)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        gap, k = self.depths[node] - depth, 0
        while gap:
            if gap & 1:
                node = self.up[node][k]
            gap >>= 1
            k += 1
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def same(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth spell the same, walking down to the first node they share."""
        while x != y:
            if self.letters[x] != self.letters[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the string of x comes before that of y."""
        depth = min(self.depths[x], self.depths[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.hashes[a] == self.hashes[b] and self.same(a, b):
            return self.depths[x] < self.depths[y]
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and k < len(self.up[b]) and self.hashes[self.up[a][k]] != self.hashes[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        if not self.same(self.up[a][0], self.up[b][0]):  # a hash collision: read the strings
            return self.text(x) < self.text(y)
        return self.letters[a] < self.letters[b]


Paths = dict[int, tuple[int, int]]  # state: (cost, node)


def _offer(tree: AuditTree, paths: Paths, state: int, cost: int, parent: int, letter: str) -> None:
    held = paths.get(state)
    if held and held[0] < cost:
        return
    node = tree.add(parent, letter)
    if not held or cost < held[0] or tree.less(node, held[1]):
        paths[state] = (cost, node)


def _with_inserts(tree: AuditTree, paths: Paths) -> Paths:
    """Paths after the inserts that pay: one leads to u, a second one to a."""
    for state in (START, S, A, U):
        if state in paths:
            cost, node = paths[state]
            _offer(tree, paths, due(state), cost + INSERT, node, "I")
    return paths


def transfers(rows: list[tuple[str, bool, bool]], entries: list[int]) -> Iterator[tuple[int, int, int, str]]:
    """(entry, exit, cost, letters) over rows of (initial, must go, truncated), inserts behind each row.

    Entries are the states before the first row; START alone means the conversation's begin,
    with inserts before the first row as well.
    """
    for entry in entries:
        tree = AuditTree()
        paths: Paths = {entry: (0, 0)}
        if entries == [START]:
            paths = _with_inserts(tree, paths)
        for initial, forced, truncated in rows:
            after: Paths = {}
            more = TRUNCATED * truncated
            for state, (cost, node) in paths.items():
                _offer(tree, after, state, cost + DELETE, node, "D")
                if not forced:
                    kept = KEEPS.get((state, initial))
                    if kept is not None:
                        _offer(tree, after, kept, cost + more, node, LEAD if kept == S else "K")
                    _offer(tree, after, due(state), cost + RETYPE + more, node, "R")
            paths = _with_inserts(tree, after)
        for exit_, (cost, node) in paths.items():
            yield entry, exit_, cost, tree.text(node)


def expanded(letters: str, copies: list[int]) -> str:
    """The audit with a D for every further copy of a row, and K for a kept s."""
    if all(n == 1 for n in copies):
        return letters.replace(LEAD, "K")
    out, row = [], 0
    for letter in letters:
        out.append(letter)
        if letter != "I":
            out.append("D" * (copies[row] - 1))
            row += 1
    return "".join(out).replace(LEAD, "K")


TRANSFER_COLUMNS = ["piece", "entry", "exit", "cost", "letters", "audit", "begin", "illegal", "first", "last"]
TRANSFER_SCHEMA = "piece long, entry int, exit int, cost long, letters string, audit string, begin long, illegal long, first string, last string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transfers of sorted (piece, conv, at, n, initial, forced, truncated) rows, one conversation of a piece at a time."""
    held: list[tuple] = []
    begun: int | None = None  # the piece in which an earlier conversation was seen

    def closed(kind: pa.DataType) -> pa.RecordBatch:
        nonlocal begun
        piece, conv = held[0][:2]
        # the first conversation of a piece may have begun in an earlier one
        entries = [START] if begun == piece else [START, S, U, A]
        begun = piece
        initials = [r[4] for r in held]
        copies = [r[3] for r in held]
        illegal = sum(copies) - len(copies) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        more = DELETE * (sum(copies) - len(copies))
        found = transfers([r[4:7] for r in held], entries)
        rest = [(piece, *way, cost + more, text, expanded(text, copies), held[0][2], illegal, initials[0], initials[-1]) for *way, cost, text in found]
        arrays = [pa.array([r[i] for r in rest]) for i in range(len(TRANSFER_COLUMNS))]
        arrays[1:3] = [a.cast(pa.int32()) for a in arrays[1:3]]
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(rest), kind), *arrays], ["conv", *TRANSFER_COLUMNS])

    kind = None
    for batch in batches:
        kind = batch.column(1).type
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:2] != held[0][:2]:
                yield closed(kind)
                held = []
            held.append(row)
    if held:
        yield closed(kind)


class _Composed:
    """The pieces of one conversation, composed as they come."""

    def __init__(self, conv: object) -> None:
        self.conv, self.settled, self.open = conv, [], {START: (0, "")}
        self.back: list[dict[int, int]] = []
        self.pieces: list[int] = []
        self.lead: dict[int, str] = {START: ""}
        self.illegal, self.last = 0, None

    def add(self, rows: list[tuple]) -> None:
        """Rows (piece, entry, exit, cost, audit, illegal, first, last) of the next piece."""
        if not self.pieces and len({r[1] for r in rows}) > 1:  # not known to be the begin when it was read
            self.lead = {START: "", U: "I", A: "II"}
            self.open = {s: (INSERT * len(t), t) for s, t in self.lead.items()}
        best: dict[int, tuple[int, str, int]] = {}
        for _, entry, exit_, cost, audit, *_ in rows:
            if entry in self.open:
                before, text = self.open[entry]
                offer = (before + cost, text + audit, entry)
                if exit_ not in best or offer < best[exit_]:
                    best[exit_] = offer
        self.pieces.append(rows[0][0])
        self.back.append({s: entry for s, (_, _, entry) in best.items()})
        shared = commonprefix([text for _, text, _ in best.values()])
        self.settled.append(shared)
        self.open = {s: (cost, text[len(shared) :]) for s, (cost, text, _) in best.items()}
        first, last = rows[0][6:8]
        self.illegal += rows[0][5] + (self.last is not None and self.last + first not in LEGAL)
        self.last = last

    def result(self) -> tuple:
        """(conv, cost, audit, illegal, choices); choices are (piece, entry, exit, inserts before)."""
        cost, rest, state = min((*self.open[s], s) for s in ENDS if s in self.open)
        choices = []
        for piece, back in zip(reversed(self.pieces), reversed(self.back)):
            choices.append({"piece": piece, "entry": back[state], "exit": state, "lead": ""})
            state = back[state]
        choices[-1]["lead"] = self.lead[state]
        return self.conv, cost, "".join(self.settled) + rest, self.illegal, choices


CHOICE = pa.struct([("piece", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("lead", pa.string())])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of sorted (conv, piece, entry, exit, cost, audit, illegal, first, last) rows."""
    one: _Composed | None = None
    held: list[tuple] = []
    done: list[tuple] = []

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 5
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.list_(CHOICE)]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "cost", "audit", "illegal", "choices"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if one is None or conv != one.conv or row[0] != held[0][0]:
                if held:
                    one.add(held)
                    held = []
                if one is None or conv != one.conv:
                    if one is not None:
                        done.append(one.result())
                    one = _Composed(conv)
            held.append(tuple(row))
        if done:
            yield flush(kind)
    if one is not None:
        one.add(held)
        done.append(one.result())
        yield flush(kind)


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that stay, (conv, at, place, edit, role), of (conv, begin, entry, lead, letters) pieces."""
    for batch in batches:
        convs, out = [], []
        for conv, begin, state, lead, letters in zip(*(c.to_pylist() for c in batch.columns)):
            at, place = begin - 1, 0
            state = START if lead else state
            for letter in lead + letters:
                at, place = (at, place + 1) if letter == "I" else (at + 1, 0)  # inserts stand behind a row
                if letter == "D":
                    continue
                role = None if letter in ("K", LEAD) else ("user", "assistant")[due(state) == A]
                state = S if letter == LEAD else due(state)
                convs.append(conv)
                out.append((at, place, "K" if letter == LEAD else letter, role))
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
        arrays = [pa.array(convs, batch.column(0).type), *(pa.array(c, k) for c, k in zip(columns, kinds))]
        yield pa.RecordBatch.from_arrays(arrays, ["conv", "at", "place", "edit", "role"])


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _same(a: str, b: str, *names: str) -> Column:
    found = F.lit(True)
    for n in names:
        found &= F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return found


class Repair(NamedTuple):
    conversations: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, piece_bits: int = PIECE_BITS) -> Repair:
    """Repair rows of (conv, turn, role, text, n), ``n`` being how often the row stands there.

    ``conversations``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row
    each. ``rows``: (conv, at, place, edit, role, text), the repaired rows in the order of
    (at, place).
    """
    one = F.lit(" ")
    rows = rows.select("conv", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"), "n")
    shown = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    narrow = rows.select(
        "conv",
        "turn",
        _digest(F.col("role"), F.col("text")).alias("digest"),
        F.substring("role", 1, 1).alias("initial"),
        (shown == "").alias("blank"),
        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("open"),
        "n",
    )
    folded = stored(grouped(narrow, ["conv", "turn", "digest"], n="sum(n)", initial="any_value(initial)", blank="any_value(blank)", open="any_value(open)"))
    firsts = grouped(folded, ["conv", "digest"], first="min(struct(turn is not null as known, turn))")
    judged = folded.alias("r").join(firsts.alias("f"), _same("r", "f", "conv", "digest")).selectExpr(
        "r.conv", "turn", "r.digest", "n", "initial", "blank", "struct(turn is not null as known, turn) > first as again", "open"
    )
    ordered = judged.selectExpr("*", "blank or again as forced", "open and not (blank or again) as truncated")
    by = ["conv", "turn", "digest"]
    ordered = stored(ordered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))

    pieces = ordered.select(F.shiftright("at", piece_bits).alias("piece"), "conv", "at", "n", "initial", "forced", "truncated")
    kind = ordered.schema["conv"].dataType.simpleString()
    # narrow rows, but much work on each: as many tasks as shuffles have, however few bytes
    tasks = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(tasks, "piece").sortWithinPartitions("piece", "at")
    moved = stored(pieces.mapInArrow(_pieces, f"conv {kind}, {TRANSFER_SCHEMA}"))
    parts = moved.select("conv", "piece", "entry", "exit", "cost", "audit", "illegal", "first", "last")
    parts = parts.repartition("conv").sortWithinPartitions("conv", "piece")
    choice = "array<struct<piece: bigint, entry: int, exit: int, lead: string>>"
    settled = stored(parts.mapInArrow(_composed, f"conv {kind}, cost long, audit string, illegal long, choices {choice}"))

    counts = grouped(
        ordered,
        ["conv", "turn"],
        blank="sum(if(blank, n, 0))",
        duplicate="sum(if(blank, 0, if(again, n, n - 1)))",
        truncated="count_if(truncated)",
    )
    counts = grouped(
        counts, ["conv"],
        gaps="coalesce(max(turn) - min(turn) + 1 - count(turn), 0)",
        blank="sum(blank)", duplicate="sum(duplicate)", truncated="sum(truncated)",
    )
    conversations = settled.alias("s").join(counts.alias("c"), _same("s", "c", "conv")).selectExpr(
        "s.conv", *(f"cast({c} as bigint) as {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "audit"
    )

    chosen = settled.selectExpr("conv", "inline(choices)")
    letters = chosen.alias("c").join(moved.alias("m"), _same("c", "m", "conv", "piece", "entry", "exit"))
    decided = letters.select("c.conv", "m.begin", "c.entry", "c.lead", "m.letters").mapInArrow(_decided, f"conv {kind}, at long, place int, edit string, role string")
    stay = decided.withColumn("row", F.when(F.col("edit") != "I", F.col("at")))
    placed = stay.alias("d").join(ordered.selectExpr("at as row", "turn", "digest").alias("o"), "row", "left")
    placed = placed.select("d.conv", "at", "place", "edit", F.col("role").alias("given"), "turn", "digest")
    texts = rows.select("conv", "turn", _digest(F.col("role"), F.col("text")).alias("digest"), "role", "text").dropDuplicates(by)
    inserted = placed.where("edit = 'I'").selectExpr("conv", "at", "place", "edit", "given as role", "'' as text")
    others = placed.where("edit <> 'I'").alias("p").join(texts.alias("t"), _same("p", "t", *by))
    others = others.selectExpr("p.conv", "at", "place", "edit", "coalesce(given, role) as role", "text")
    return Repair(conversations, others.unionByName(inserted))


def digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of repaired rows: of their ``role:text`` lines, in order.

    A digest takes its bytes in sequence: lines stream through it, and no more than a batch is held.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    lines = rows.select("conv", "at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "at", "place").select("conv", "line").mapInArrow(_hashed, f"conv {kind}, sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    conv, digest, kind = None, None, None
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        names, marks = [c for c, _ in done], [d for _, d in done]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(marks, pa.string())], ["conv", "sha256"])

    for batch in batches:
        kind = batch.column(0).type
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1)):
            if digest is None or name != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = name, sha256()
            else:
                digest.update(b"\n")
            digest.update(line.as_py().encode("utf-8", "surrogatepass"))
        if done:
            yield flush()
    if digest is not None:
        done.append((conv, digest.hexdigest()))
        yield flush()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n): rows of (conv, turn, role, text) after a damage that their numbers decide.

    By the crc32 of ``conv:turn`` modulo 20: 0 is dropped, 1 loses its text, 2 its ``.!?``, 3
    stands there twice, 4 becomes the user's. A missing value counts as one space.
    """
    one = F.lit(" ")
    mark = F.concat(F.coalesce(F.col("conv").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kept = rows.withColumn("mark", F.crc32(mark) % 20).where("mark <> 0")
    text, role = F.coalesce("text", one), F.coalesce("role", one)
    return kept.select(
        "conv",
        "turn",
        F.when(F.col("mark") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("mark") == 3, 2).otherwise(1).cast("long").alias("n"),
    )
