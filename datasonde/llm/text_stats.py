"""Counts over the words, lines and characters of whole texts.

A text is read as UTF-8 bytes: one table look-up classes its characters, one split gives its
words, and windows of words are numbered exactly by joining the numbers of their halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of bytes; a byte in none of them is 0.
CLASSES = {
    "space": b" \t\x0b\x0c\r",
    "newline": b"\n",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "pipe": b"|",
    "markup": b"#*$%&<>",
    "shout": b"!?",
    "stop": b".,;:",
    "lead": bytes(range(0xC0, 0x100)),
    "tail": bytes(range(0x80, 0xC0)),
}
_NUMBER = {name: i + 1 for i, name in enumerate(CLASSES)}
_CLASS_OF = np.zeros(256, np.uint8)
for _name, _bytes in CLASSES.items():
    _CLASS_OF[list(_bytes)] = _NUMBER[_name]

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPE = (
    "log_words",
    "word_length",
    "long_words",
    "symbol_share",
    "pipe_share",
    "shout_share",
    "stop_share",
    "digit_share",
    "upper_share",
    "letter_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "top_word_share",
    "echo_share",
    "mean_line_words",
)
REPEAT_WINDOW = 8


def repeated_words(numbers: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``width`` (a power of two) that occur twice or more."""
    rank, step = numbers, 1
    while step < width:
        if len(rank) <= step:
            return 0
        pairs = rank[:-step] * np.int64(len(numbers) + 1) + rank[step:]
        _, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:  # longer windows can't repeat either
            return 0
        step *= 2
    starts = np.flatnonzero(counts[rank] > 1)
    edges = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the shape of one text; a missing text is measured as an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS_OF[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)
    n = {name: int(kinds[i]) for name, i in _NUMBER.items()}
    words = data.split()
    n_words = len(words)
    if not n_words:
        return [0] * len(BASE), [0.0] * len(SHAPE)
    word_chars = len(data) - n["tail"] - n["space"] - n["newline"]
    symbols = n["pipe"] + n["markup"]
    first: dict[bytes, int] = {}
    numbers = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n_words)
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(numbers) if len(first) < n_words else 0
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    base = [n_words, word_chars, symbols, dup_lines, repeats]
    shape = [
        float(np.log1p(n_words)),
        word_chars / n_words,
        float((lengths > 12).mean()),
        symbols / word_chars,
        n["pipe"] / word_chars,
        n["shout"] / word_chars,
        n["stop"] / word_chars,
        n["digit"] / word_chars,
        n["upper"] / word_chars,
        (n["upper"] + n["lower"] + n["lead"]) / word_chars,
        dup_lines / len(lines),
        repeats / n_words,
        len(first) / n_words,
        float(np.bincount(numbers).max()) / n_words,
        float((numbers[1:] == numbers[:-1]).mean()) if n_words > 1 else 0.0,
        min(n_words / len(lines), 1000.0),
    ]
    return base, shape


def measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base counts and shapes of a column of texts, a row for each."""
    rows = [measure(t.as_py()) for t in texts]
    base = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
    shape = np.array([r[1] for r in rows], np.float64).reshape(-1, len(SHAPE))
    return base, shape


def shapes(docs: DataFrame) -> DataFrame:
    """(id, shape) of (id, text) rows; texts without a word give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, shape = measured(batch.column(1))
            some = base[:, 0] > 0
            columns = [batch.column(0).filter(pa.array(some)), *(pa.array(shape[some, i]) for i in range(len(SHAPE)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", *SHAPE])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} double" for c in SHAPE)]))


def shape_matrix(rows: DataFrame) -> np.ndarray:
    """The shapes of a bounded sample, on the driver, in an order that doesn't depend on the tasks."""
    found = sorted(tuple(r) for r in rows.select(*SHAPE).collect())
    return np.array(found, np.float64).reshape(-1, len(SHAPE))


def hash_sample(rows: DataFrame, at_most: int, salt: str, key: str = "id") -> DataFrame:
    """About ``at_most`` of the rows, chosen by a salted hash of the id; all of them if there are no more."""
    n = rows.count()
    if n <= at_most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * at_most / n))
