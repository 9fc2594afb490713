"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A text's fingerprint has a bit for each of the 64 bits of its shingles' hashes, set if most
shingles have it set. Texts whose fingerprints differ in at most four bits are linked, and
links make groups.

The perfect (23, 12) code maps every 23-bit word to one codeword at most three errors away. A
fingerprint is cut in three segments. Each has a home, the codeword it decodes to, and
neighbours, those it decodes to after a change of any one bit: six codewords at most. Of four
errors in three segments,

* either a segment has none: the segment itself is a key;
* or two segments have one each: the home of one is then a neighbour of the other, and both
  texts have the key (home of i in one, home of j in the other) among their pairs of
  home and neighbours of i and j.

So no link is lost. Fingerprints, not texts, are keyed, so copies count once. What shares a
key is verified by its bits. With ``third_segment`` the neighbours of the remaining segment,
which then has at most two errors, are part of each key: 234 instead of 39 keys for a
fingerprint, but a hundred times fewer chance meetings, which pays from some 10^8
fingerprints on, as chance meetings grow with their square.

Keys of many fingerprints (a dense group of near copies) are split in blocks, each pair of
blocks a group of its own of bounded size. In a group a search visits every fingerprint once
and gives one link for each member, not all pairs. Components of the links are found by
alternating stars; nothing but counts comes to the driver.

A missing, empty or blank text has no shingle and fingerprint 0, which links like any other.
Rows with one id or repeated rows are linked like others; a missing id is never the smallest
unless a group has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasonde.functions.shared import stored
from datasonde.llm.columns import packed, unpacked
from datasonde.llm.components import components

SHINGLE_WORDS = 5
SEED = 42
MAX_BITS = 4
# Where each segment starts, and its width.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# The generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
# The most fingerprints that one group compares; small runs are compared by shifting.
BLOCK = 4096
SMALL_RUN = 32


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    count = len(words) - width + 1
    totals = np.zeros(64, np.int64)
    for first in range(0, count, 1 << 16):
        last = min(first + (1 << 16), count)
        spans = zip(starts[first:last].tolist(), ends[first + width - 1 : last + width - 1].tolist())
        hashes = np.array([digest(body[a:b], SEED) for a, b in spans], "<u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * totals > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, digest, fp) of (id, digest, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], ["id", "digest", "fp"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "digest", "text").mapInArrow(run, f"id {kind}, digest long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 23 bits by the generator, and the least error pattern of each remainder."""
    remainders = np.zeros(23, np.int64)
    r = 1
    for i in range(23):
        remainders[i] = r
        r <<= 1
        if r >> 11:
            r ^= GENERATOR
    patterns = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            patterns[np.bitwise_xor.reduce(remainders[list(bits)])] = sum(1 << b for b in bits)
    return remainders, patterns


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    remainders, patterns = _golay()
    remainder = np.zeros(words.shape, np.int64)
    for bit in range(23):
        remainder ^= np.where((words >> bit) & 1, remainders[bit], 0)
    return (words ^ patterns[remainder]) >> 11


def _near(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Homes, and the (at most six) distinct codewords within one change, a column each, filled up with the home."""
    home = decode(segment)
    reached = np.stack([home, *(decode(segment ^ (1 << b)) for b in range(width))], axis=1)
    reached.sort(axis=1)
    fresh = np.hstack([np.ones((len(reached), 1), bool), reached[:, 1:] != reached[:, :-1]])
    order = np.argsort(~fresh, axis=1, kind="stable")[:, :6]
    near = np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(reached, order, 1), home[:, None])
    return home, near


def keys_of(marks: np.ndarray, third_segment: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``marks``, key): all keys of each fingerprint, repeated ones left out."""
    bits = marks.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    coded = [_near(p, width) for p, (_, width) in zip(parts, SEGMENTS)]
    columns = []
    for i, part in enumerate(parts):
        if third_segment:  # of four errors in two segments, one has at most two
            columns += [(1 + i * 3 + j) << 40 | part[:, None] << 12 | coded[j][1] for j in range(3) if j != i]
        else:
            columns.append(((1 + i * 3 + i) << 40 | part)[:, None])
    for i, j in combinations(range(3), 2):
        (home_i, near_i), (home_j, near_j) = coded[i], coded[j]
        pair = np.hstack([near_i << 12 | home_j[:, None], home_i[:, None] << 12 | near_j])
        if third_segment:
            pair = (pair[:, :, None] << 12 | coded[3 - i - j][1][:, None, :]).reshape(len(pair), -1)
        columns.append((10 + i + j) << 40 | pair)
    keys = np.sort(np.hstack(columns), axis=1)
    fresh = np.hstack([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]])
    rows, at = np.nonzero(fresh)
    return rows, keys[rows, at]


def _keyed(marks: DataFrame, third_segment: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start in range(0, len(values), 2000):
                some = values[start : start + 2000]
                rows, keys = keys_of(some, third_segment)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows])], ["key", "fp"])

    return marks.select("fp").mapInArrow(run, "key long, fp long")


def apart(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Bits that differ; counted unsigned, as the sign is a bit like any other."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning_links(marks: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A link from the first member to every other of each group under the distance, by visiting each mark once."""
    rest = np.unique(marks)
    first, other = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        waiting = [root]
        while waiting and len(rest):
            close = apart(rest, waiting.pop()) <= most
            if close.any():
                found = rest[close]
                first.append(np.full(len(found), root))
                other.append(found)
                waiting.extend(found)
                rest = rest[~close]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *first]), np.concatenate([empty, *other])


def links_of(group: np.ndarray, marks: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal group numbers (sorted)."""
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    sizes = np.diff(edges)
    out = [spanning_links(marks[a : a + n], most) for a, n in zip(edges[:-1], sizes) if n > SMALL_RUN]
    small = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
    group, marks = group[small], marks[small]
    for shift in range(1, SMALL_RUN):
        near = np.flatnonzero(group[shift:] == group[:-shift]) if len(group) > shift else np.empty(0, np.int64)
        if not len(near):
            break
        a, b = marks[near], marks[near + shift]
        close = apart(a, b) <= most
        out.append((a[close], b[close]))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *(a for a, _ in out)]), np.concatenate([empty, *(b for _, b in out)])


def _linked(most: int):
    """Links over sorted (key, low, high, fp) batches; a run that a batch cuts is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            new = (rows[:3, 1:] != rows[:3, :-1]).any(0)
            numbers = np.concatenate([[0], np.cumsum(new)])
            a, b = links_of(numbers, rows[3], most)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            rows = np.hstack([held, np.stack(columns)])
            if not rows.shape[1]:
                continue
            same = (rows[:3] == rows[:3, -1:]).all(0)
            cut = rows.shape[1] - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield found(rows[:, :cut])
            held = rows[:, cut:]
        if held.shape[1]:
            yield found(held)

    return run


def fingerprint_links(marks: DataFrame, most: int = MAX_BITS, third_segment: bool = False, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at most ``most`` (four) bits apart."""
    if most > MAX_BITS:
        raise ValueError(f"the keys find fingerprints up to {MAX_BITS} bits apart")
    keyed = stored(_keyed(marks, third_segment))
    # Keys of more than a block; stored, so that they are broadcast only if they are known to be few.
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    full = stored(full.select("key", F.ceil(F.col("n") / (block / 2)).cast("int").alias("blocks")))
    rows = keyed.join(full, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", F.coalesce("own", F.lit(0))).withColumn("other", F.explode(others))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    sorted_ = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return sorted_.mapInArrow(_linked(most), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, most: int = MAX_BITS, third_segment: bool = False) -> DataFrame:
    """(id, digest, fp, root, component) of every (id, digest, text) row.

    ``root`` is the least fingerprint of the row's group, ``component`` the smallest id in it.
    """
    marks = stored(fingerprints(docs, words_per_shingle))
    firsts = stored(marks.groupBy("fp").agg(F.min("id").alias("first")))
    groups = components(fingerprint_links(firsts, most, third_segment))
    grouped = firsts.join(groups.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component"))
    named = grouped.join(smallest, "root").select("fp", "root", "component")
    return marks.join(named, "fp").select("id", "digest", "fp", "root", "component")


def without_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words_per_shingle: int = SHINGLE_WORDS, most: int = MAX_BITS, third_segment: bool = False) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (and of the smallest hash of its text)."""
    body = F.col(f"`{text}`")
    rows = packed(docs, id=F.col(f"`{key}`"), digest=F.xxhash64(body), text=body)
    found = near_duplicates(rows, words_per_shingle, most, third_segment)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")).alias("c"))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    of = ["unnamed", "name", "digest"]  # no nulls: the join and the window below share one shuffle of the texts
    chosen = chosen.select("c.*").select("unnamed", name.alias("name"), "digest")
    left = rows.select("row", F.col("id").isNull().alias("unnamed"), name.alias("name"), "digest").join(chosen, of, "left_semi")
    one = F.row_number().over(Window.partitionBy(*of).orderBy(F.lit(0)))  # repeated rows are alike
    return unpacked(left.withColumn("copy", one).filter("copy = 1"), docs.columns)
