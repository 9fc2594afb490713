"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Every run of ``WINDOW`` words of a benchmark item is a window; a shorter item is one window of
its own length. A document holds a window only if it holds all of its words, so of a window's
words, ordered by rarity in the corpus, a prefix of one, the rarest, is necessary. The join is
on that word:

1. One pass over the documents counts the words that benchmark windows hold.
2. Each distinct window gets its rarest word and the words before and after it.
3. A second pass emits, where such a word stands in a document, the words around it.
4. Both meet on the rare word. The position of the word in the window fixes where the window
   would start, so the length bound (it must fit into the text) and the positional bound are
   met by construction, and equal words before and after verify exact containment.

Which words to look for reaches the tasks as a bit table of fixed size, whatever the size of
the benchmark; a word that only shares a bit finds no partner in the join. A rare word that a
third of the documents hold is split by adaptive execution, as the windows that share it are few.

Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case.
A missing or wordless text has no words and is clean; a missing or wordless item has no window.
Repeated items count once by id, a missing id as the text ``null``. Rows of one id and one text
get one result each. Empty tables are fine on both sides.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datasonde.functions.shared import stored
from datasonde.llm.columns import packed, unpacked

WINDOW = 10
FILTER_BITS = 1 << 24
FLUSH_ROWS = 20_000

# Bytes that aren't part of a word become spaces, A-Z lower case.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct (item, words) rows; items are (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = [w.decode("utf-8", "surrogatepass") for w in words_of(text.as_py())]
                for i in range(max(len(words) - width + 1, 1) if words else 0):
                    names.append(name)
                    found.append(words[i : i + width])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.list_(pa.string()))], ["item", "words"])

    return items.select("item", "text").mapInArrow(run, "item string, words array<string>").distinct()


def _table_of(words: DataFrame) -> np.ndarray:
    """The bits of the hashes of a column ``word``, as a table of fixed size; at most one row a byte comes to the driver."""
    bits = words.select((F.crc32(F.encode("word", "utf-8")) % FILTER_BITS).alias("bit")).distinct()
    bytes_ = bits.groupBy(F.expr("bit div 8").cast("int").alias("at")).agg(F.expr("cast(sum(shiftleft(1, cast(bit % 8 as int))) as int)").alias("value"))
    rows = bytes_.toArrow()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[rows["at"].to_numpy()] = rows["value"].to_numpy()
    return table


def _marked(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """Positions of the words whose bit is set."""
    bits = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % FILTER_BITS
    return np.flatnonzero((table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1)


def corpus_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): how often the words of ``vocabulary`` stand in all documents; words that never do are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(_table_of(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([w.decode("utf-8", "surrogatepass") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                counts.update([words[i] for i in _marked(words, table)])
                if len(counts) > FLUSH_ROWS:
                    yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.join(vocabulary, "word", "left_semi")


def _with_rarest(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(rare, before, after, width, place, words) of each distinct window."""
    distinct = stored(windows.select("words").distinct())
    placed = distinct.select("words", F.posexplode("words").alias("place", "word"))
    counts = corpus_counts(docs, placed.select("word").distinct())
    ranked = placed.join(counts, "word", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("r"))
    before = F.array_join(F.slice("words", 1, F.col("r.place")), " ")
    after = F.array_join(F.slice("words", F.col("r.place") + 2, F.size("words")), " ")
    return ranked.select(F.col("r.word").alias("rare"), before.alias("before"), after.alias("after"), F.size("words").alias("width"), F.col("r.place").alias("place"), "words")


def _emitted(docs: DataFrame, rare: DataFrame, width: int) -> DataFrame:
    """Per document its number of words, and where a rare word stands: (id, digest, n_words, at, rare, left, right)."""
    sent = docs.sparkSession.sparkContext.broadcast(_table_of(rare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, reach = sent.value, width - 1
        names = ["row", "n_words", "at", "rare", "left", "right"]
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}

            def flush() -> pa.RecordBatch:
                rows = pa.array(out["row"], pa.int64())
                arrays = [batch.column(0).take(rows), batch.column(1).take(rows)]
                kinds = {"n_words": pa.int64(), "at": pa.int64()}
                arrays += [pa.array(out[n], kinds.get(n, pa.string())) for n in names[1:]]
                for n in names:
                    out[n].clear()
                return pa.RecordBatch.from_arrays(arrays, ["id", "digest", *names[1:]])

            def add(*values) -> None:
                for n, v in zip(names, values):
                    out[n].append(v)

            for row, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                add(row, len(words), None, None, None, None)
                for at in map(int, _marked(words, table)):
                    left = b" ".join([b"", *words[max(at - reach, 0) : at], b""])
                    right = b" ".join([b"", *words[at + 1 : at + 1 + reach], b""])
                    add(row, len(words), at, words[at].decode("utf-8", "surrogatepass"), left.decode("utf-8", "surrogatepass"), right.decode("utf-8", "surrogatepass"))
                if len(out["row"]) > FLUSH_ROWS:
                    yield flush()
            yield flush()

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, digest long, n_words long, at long, rare string, left string, right string"
    return docs.select("id", "digest", "text").mapInArrow(run, schema)


def contained_windows(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Documents (id, digest, n_words), and (id, digest, item, start, end) of every window they hold."""
    named = items.select(F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), "text")
    windows = stored(windows_of(named, width))
    rarest = stored(_with_rarest(windows, docs))
    emitted = stored(_emitted(docs, rarest.select(F.col("rare").alias("word")), width))
    # Each window with its items: one row however many items hold it.
    owners = windows.groupBy("words").agg(F.collect_set("item").alias("items"))
    keyed = rarest.join(owners, "words").drop("words")
    bound = (F.col("before") == "") | F.col("left").endswith(F.concat(F.lit(" "), "before", F.lit(" ")))
    bound &= (F.col("after") == "") | F.col("right").startswith(F.concat(F.lit(" "), "after", F.lit(" ")))
    found = emitted.filter(F.col("rare").isNotNull()).join(keyed, "rare").filter(bound)
    start = F.col("at") - F.col("place")
    found = found.select("id", "digest", "items", start.alias("start"), (start + F.col("width")).alias("end"))
    return emitted.filter(F.col("rare").isNull()).select("id", "digest", "n_words"), found


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(id, digest, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of (id, digest, text)."""
    base, found = contained_windows(docs, items, width)
    # Covered positions: what each range adds beyond all that start before it.
    ranges = found.select("id", "digest", "start", "end").distinct()
    before = Window.partitionBy("id", "digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.col("start")))
    added = ranges.withColumn("added", F.greatest(F.col("end") - reached, F.lit(0)))
    hits = added.groupBy("id", "digest").agg(F.sum("added").alias("n_hit"))
    held = found.select("id", "digest", F.explode("items").alias("item")).distinct()
    held = held.groupBy("id", "digest").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = base.alias("b").join(hits.alias("h"), _same("b", "h"), "left").join(held.alias("i"), _same("b", "i"), "left")
    items_ = F.coalesce(F.col("i.items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("h.n_hit"), F.lit(0)).cast("long")
    return rows.select(
        "b.id",
        "b.digest",
        "b.n_words",
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _same(a: str, b: str):
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    body = F.col(f"`{text}`")
    rows = packed(docs, id=F.col(f"`{key}`"), digest=F.xxhash64(body), text=body)
    named = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    _, found = contained_windows(rows, named, width)
    dirty = found.select("id", "digest").distinct()
    clean = rows.alias("d").join(dirty.alias("x"), _same("d", "x"), "left_anti")
    return unpacked(clean.select("d.row"), docs.columns)
