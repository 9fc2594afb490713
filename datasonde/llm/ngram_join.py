"""Similarity join of documents by the Jaccard similarity of their word n-grams.

The overlaps of all pairs of documents are the product of the sparse incidence matrix (document
by n-gram) with its transpose. It is formed block by block, a block being the columns that one
task holds, and overlap counts are added up over the blocks. What can't reach the similarity
never enters the product, or leaves it as soon as its count shows that:

* **Columns.** With a similarity of p % a pair shares p % of each set. N-grams have one order, the
  very frequent ones last; if two sets are similar, they share one of the first (100 - p) % of
  either, and of the shorter one's first (100 - p) / (100 + p). Only these parts form the product.
* **Pairs.** Sizes must lie within p %; a shared n-gram's places in both sets bound the overlap;
  and once all counts of a pair are added up, so does their sum with what follows the last shared
  n-gram, or with what the first parts leave out. The few pairs left are verified on whole sets.

Frequent n-grams are told by a table of counters of fixed size, filled in one pass over all
documents. A counter is never below the number of sets that hold its n-gram, so columns that are
not frequent are short, and pairs are formed within them. Frequent columns (a passage of a third
of the documents, a large group of near copies) make no pairs: every member meets the leader, the
member with the fewest rarer n-grams before the column's. Verified links give components; only
columns whose members are still in several components go on, and there only members of the
smaller components meet members of others. Two sets that share a rarer n-gram are in the product
already, so a pair of a frequent column shares frequent n-grams only: what is rare in a set
lowers its bound, which leaves next to no pairs. So no link between components is lost, and a
group of near copies costs a row a member. What stays costly are many documents
made of frequent passages alone that are similar in part without being linked.

Documents of one set are one row of the matrix, told by a 64-bit hash of the set; n-grams are
64-bit hashes. The table, 2^``TABLE_BITS`` counters, suits some 2^30 n-grams; beyond that a
larger one keeps the columns short. Results are the same for any.

A missing, empty or blank text has no n-gram and is linked with nothing, itself a component. Rows
of one id are documents of their own; a missing id is never the smallest unless a component has
no other. Very long texts are hashed in blocks. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasonde.functions.shared import stored
from datasonde.functions.values import grouped
from datasonde.llm.components import components

WORDS = 5
PERCENT = 80
TABLE_BITS = 20
CHUNK = 1 << 14
# Above this, and above what an average counter holds by chance, an n-gram is frequent.
FREQUENT = 64
KEY_BITS = 24
BLOCK = 1 << 16
FLUSH = 200_000

MULTIPLIER = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(42).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, 2^bits of them."""
    out = []
    for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        table = np.full(1 << bits, base, np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Hashes of the distinct runs of ``width`` words, or of all words if there are fewer; sorted."""
    body = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())  # bytes: A-Z only, ASCII white space
    if not body:
        return np.empty(0, np.uint64)
    data = np.frombuffer(body, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(ends))
    out = []
    for first in range(0, len(ends) - width + 1, BLOCK):
        last = min(first + BLOCK, len(ends) - width + 1)
        low, high = int(starts[first]), int(ends[last + width - 2])
        power, inverse = _powers(max(20, (high - low).bit_length()))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[low:high]] * power[: high - low], out=total[1:])
        a, b = starts[first:last] - low, ends[first + width - 1 : last + width - 1] - low
        h = (total[b] - total[a]) * inverse[a]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        out.append(h)
    return np.unique(out[0] if len(out) == 1 else np.concatenate(out))


def set_key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), 42)).view(np.int64)) if len(hashes) else 0


def probe_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first n-grams of a set of n meet any similar one's."""
    return n + 1 + (-percent * n) // 100


def index_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first n-grams of a set of n meet a similar one's that isn't smaller."""
    return n + 1 + (-2 * percent * n) // (100 + percent)


def possible(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of a and b n-grams with this overlap, at most, can be similar."""
    return (100 + percent) * overlap >= percent * (a + b)


def _possible(overlap: str, a: str, b: str, percent: int) -> str:
    return f"{100 + percent}L * ({overlap}) >= {percent}L * ({a} + {b})"


def _sized(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """(id, key, n) of each (id, text) row, and (chunk, counts) rows of each task's table of counters."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "n", "chunk", "counts"]
        table, seen = np.zeros(1 << bits, np.uint32), set()
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            keys, sizes, fresh = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                keys.append(set_key(found))
                sizes.append(len(found))
                if keys[-1] not in seen:
                    seen.add(keys[-1])
                    fresh.append(found >> np.uint64(64 - bits))
            if fresh:
                at, counts = np.unique(np.concatenate(fresh), return_counts=True)
                table[at.astype(np.int64)] += counts.astype(np.uint32)
            none = len(keys)
            arrays = [batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if id_type is not None:
            for chunk, part in enumerate(table.reshape(-1, CHUNK)):
                if part.any():
                    arrays = [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, key long, n long, chunk int, counts binary")


def _table(sized: DataFrame, bits: int) -> np.ndarray:
    """The tasks' tables added up, saturating; the driver gets one table, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, None

        def row() -> pa.RecordBatch:
            part = np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.binary())], ["chunk", "counts"])

        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != chunk:
                    if chunk is not None:
                        yield row()
                    chunk, total = number, np.zeros(CHUNK, np.uint64)
                total += np.frombuffer(counts.as_buffer(), np.uint32)
        if chunk is not None:
            yield row()

    parts = sized.where("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    table = np.zeros(1 << bits, np.uint32)
    for number, part in zip(*(c.to_pylist() for c in parts.mapInArrow(run, "chunk int, counts binary").toArrow().columns)):
        table[number * CHUNK : (number + 1) * CHUNK] = np.frombuffer(part, np.uint32)
    return table


def frequent_from(table: np.ndarray, least: int = FREQUENT) -> int:
    mean = float(table.mean(dtype=np.float64))
    return int(least + mean + 8 * mean**0.5)


def _columns(docs: DataFrame, sent: Broadcast, width: int, percent: int) -> DataFrame:
    """(hot, token, key, size, pos, cold): the first n-grams of each set, once a task; ``cold`` counts its n-grams that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, limit = sent.value
        shift = np.uint64(64 - (len(table).bit_length() - 1))
        seen: set[int] = set()
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hot", "token", "key", "size", "pos", "cold"])

        for batch in batches:
            rows = 0
            for text in batch.column(0):
                found = shingles(text.as_py(), width)
                n, key = len(found), set_key(found)
                if not n or key in seen:
                    continue
                seen.add(key)
                counts = table[(found >> shift).astype(np.int64)]
                counts = np.where(counts > limit, counts, 0)
                cold = int((counts == 0).sum())
                order = np.lexsort((found, counts))[: int(probe_length(np.int64(n), percent))]
                k = len(order)
                held.append([counts[order] > 0, found[order].view(np.int64), np.full(k, key, np.int64), np.full(k, n, np.int32), np.arange(k, dtype=np.int32), np.full(k, cold, np.int32)])
                rows += k
                if rows > FLUSH:
                    yield flush()
                    rows = 0
            if held:
                yield flush()

    return docs.select("text").mapInArrow(run, "hot boolean, token long, key long, size int, pos int, cold int")


MEETING = ["token", "a", "size_a", "pos_a", "b", "size_b", "pos_b", "cold_a", "cold_b"]


def _product(percent: int):
    """One block of the product over sorted (hot, token, size, key, pos, cold) rows.

    Gives (token, a, size_a, pos_a, b, size_b, pos_b) for the n-grams that two sets share, and
    rows without b but with cold_a for the members of frequent columns.
    """

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        hot, token, size, key, pos, cold = rows
        near = np.flatnonzero((token[1:] == token[:-1]) & (hot[1:] == 0)) if len(token) > 1 else np.empty(0, np.int64)
        step = 1
        while len(near):
            a, b = near, near + step
            most = np.minimum(pos[a], pos[b]) + 1 + np.minimum(size[a] - pos[a] - 1, size[b] - pos[b] - 1)
            good = possible(most, size[a], size[b], percent)
            if good.any():
                a, b = a[good], b[good]
                yield _batch([token[a], key[a], size[a], pos[a], key[b], size[b], pos[b], cold[a], cold[b]])
            step += 1
            near = near[near + step < len(token)]
            near = near[token[near] == token[near + step]]
        kept = np.flatnonzero(hot)
        if len(kept):
            yield _batch([token[kept], key[kept], size[kept], pos[kept], None, None, None, cold[kept], None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((6, 0), np.int64)
        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.hstack([held, new])
            if not rows.shape[1]:
                continue
            fresh = np.append(True, (rows[[1, 3], 1:] != rows[[1, 3], :-1]).any(0))
            rows = rows[:, fresh]  # the same set from several tasks
            cut = int(np.searchsorted(-(rows[1, ::-1] == rows[1, -1]).astype(np.int8), 0))
            cut = rows.shape[1] - cut
            yield from pairs(rows[:, :cut])
            held = rows[:, cut:]
        if held.shape[1]:
            yield from pairs(held)

    return run


def _batch(columns: list[np.ndarray | None]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)], MEETING)


def _counted(met: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose overlap counts, added up over all blocks, leave a similarity possible."""
    index = f"pos_a < {_index('size_a', percent)}"
    summed = grouped(
        met.where("b is not null"),
        ["a", "b", "size_a", "size_b", "cold_a", "cold_b"],
        shared="count(*)",
        at_a="max(pos_a)",
        at_b="max(pos_b)",
        begun=f"max({index})",
    )
    # n-grams that aren't frequent come first, and of a set's first part all shared ones are counted
    left = [f"size_{x} - least(cold_{x}, {_probe(f'size_{x}', percent)})" for x in "ab"]
    bound = f"shared + least(size_a - at_a - 1, size_b - at_b - 1, greatest({left[0]}, {left[1]}))"
    return summed.where(f"begun and {_possible(bound, 'size_a', 'size_b', percent)}").select("a", "b")


def _probe(n: str, percent: int) -> str:
    return f"({n} - cast(ceil({percent}L * {n} / 100D) as int) + 1)"


def _index(n: str, percent: int) -> str:
    return f"({n} - cast(ceil({2 * percent}L * {n} / {100 + percent}D) as int) + 1)"


def _ordered_pairs(rows: DataFrame, percent: int, more: str = "true") -> DataFrame:
    """(a, b), the smaller set first, of rows with two members x and y of one column; only pairs that the bounds allow."""
    first = "(x.size < y.size or x.size = y.size and x.key < y.key)"
    short = f"if({first}, x.pos < {_index('x.size', percent)}, y.pos < {_index('y.size', percent)})"
    # frequent n-grams follow all others, of which the pair has none in common
    most = "least(x.pos - x.cold, y.pos - y.cold) + least(x.size - x.pos, y.size - y.pos)"
    allowed = rows.where(f"x.key <> y.key and {short} and {_possible(most, 'x.size', 'y.size', percent)} and ({more})")
    return allowed.selectExpr(f"if({first}, x.key, y.key) as a", f"if({first}, y.key, x.key) as b").distinct()


def _members(met: DataFrame) -> DataFrame:
    return met.where("b is null").selectExpr("token", "struct(pos_a as pos, a as key, size_a as size, cold_a as cold) as x")


def _led(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): every member of a frequent column with the column's leader."""
    leaders = grouped(members, ["token"], y="min(x)")
    return _ordered_pairs(members.join(leaders, "token"), percent)


def _open(members: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): in frequent columns of several components, members of the smaller ones with members of others."""
    placed = members.withColumn("key", F.col("x.key")).join(groups.selectExpr("node as key", "root"), "key", "left")
    placed = placed.selectExpr("token", "x", "coalesce(root, key) as root")
    sizes = grouped(placed, ["token", "root"], cnt="count(*)")
    largest = grouped(sizes, ["token"], main="max(struct(cnt, root)).root", n_roots="count(*)").where("n_roots > 1")
    rows = stored(placed.join(largest.select("token", "main"), "token"))
    few = rows.where("root <> main").selectExpr("token", "x as y", "root as other")
    both = rows.join(few, "token").where("root <> other")
    return _ordered_pairs(both, percent, "root = main or x.key < y.key")


def _key_table(keys: DataFrame) -> np.ndarray:
    """The bits of a column ``key`` as a table of fixed size; at most one row a byte comes to the driver."""
    bits = keys.selectExpr(f"key & {(1 << KEY_BITS) - 1}L as bit").distinct()
    found = bits.groupBy(F.expr("cast(bit div 8 as int)").alias("at")).agg(F.expr("cast(sum(shiftleft(1, cast(bit % 8 as int))) as int)").alias("value")).toArrow()
    table = np.zeros(1 << (KEY_BITS - 3), np.uint8)
    table[found["at"].to_numpy()] = found["value"].to_numpy()
    return table


def _sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, tokens) of the documents whose key is among ``keys``, and of some that share a bit with one."""
    sent = docs.sparkSession.sparkContext.broadcast(_key_table(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sent.value, set()
        names = ["key", "tokens"]
        for batch in batches:
            keys_, sets, rows = [], [], 0

            def flush() -> pa.RecordBatch:
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                out = pa.RecordBatch.from_arrays([pa.array(keys_, pa.int64()), pa.ListArray.from_arrays(ends, values)], names)
                keys_.clear()
                sets.clear()
                return out

            for text in batch.column(0):
                found = shingles(text.as_py(), width)
                key = set_key(found)
                bit = key & ((1 << KEY_BITS) - 1)
                if len(found) and key not in seen and table[bit >> 3] >> (bit & 7) & 1:
                    seen.add(key)
                    keys_.append(key)
                    sets.append(found)
                    rows += len(found)
                    if rows > FLUSH:
                        yield flush()
                        rows = 0
            yield flush()

    return docs.select("text").mapInArrow(run, "key long, tokens array<bigint>").dropDuplicates(["key"])


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (a, b) among the pairs, by their whole sets, each of which is shuffled to its pairs once."""
    pairs = stored(pairs)
    sides = pairs.selectExpr("a", "b", "inline(array(struct(a as key, true as short), struct(b as key, false as short)))")
    sets = _sets(docs, sides.select("key").distinct(), width)
    met = sides.join(sets, "key").groupBy("a", "b")
    both = met.agg(F.expr("any_value(if(short, tokens, null), true) as x"), F.expr("any_value(if(short, null, tokens), true) as y"))
    return stored(both.where(_possible("size(array_intersect(x, y))", "size(x)", "size(y)", percent)).select("a", "b"))


def set_links(docs: DataFrame, sized: DataFrame, width: int = WORDS, percent: int = PERCENT, bits: int = TABLE_BITS, frequent: int = FREQUENT) -> DataFrame:
    """(node, root) of the sets that are linked; nothing but the table of counters comes to the driver."""
    table = _table(sized, bits)
    sent = docs.sparkSession.sparkContext.broadcast((table, frequent_from(table, frequent)))
    columns = _columns(docs, sent, width, percent)
    dealt: Column = F.when(F.col("hot"), F.xxhash64("token", "key")).otherwise(F.col("token"))
    columns = columns.repartition(dealt).sortWithinPartitions("hot", "token", "size", "key").select("hot", "token", "size", "key", "pos", "cold")
    met = stored(columns.mapInArrow(_product(percent), "token long, a long, size_a int, pos_a int, b long, size_b int, pos_b int, cold_a int, cold_b int"))
    members = _members(met)
    links = _verified(docs, _counted(met, percent).unionByName(_led(members, percent)).distinct(), width, percent)
    groups = components(links)
    rest = stored(_open(members, groups, percent))
    if rest.isEmpty():
        return groups
    return components(links.unionByName(_verified(docs, rest, width, percent)))


def joined(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, bits: int = TABLE_BITS, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_shingles, component) of each (id, text) row; ``component`` is the smallest id that links reach."""
    sized = stored(_sized(docs, width, bits))
    groups = stored(set_links(docs, sized, width, percent, bits, frequent))
    rows = sized.where("chunk is null").select("id", "key", "n")
    firsts = grouped(rows.where("n > 0"), ["key"], first="min(id)")
    grouped_ = firsts.join(groups.selectExpr("node as key", "root"), "key", "left").selectExpr("key", "first", "coalesce(root, key) as root")
    smallest = grouped(grouped_, ["root"], component="min(first)")
    named = grouped_.join(smallest, "root").select("key", "component")
    found = rows.join(named, "key", "left")
    return found.selectExpr("id", "n as n_shingles", "if(n = 0, id, component) as component")
