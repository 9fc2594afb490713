"""Language ID by multilingual mixture inference.

Every language has a likelihood for each character n-gram (hashed to ``BUCKETS`` cells),
counted over all training texts. A document is a mixture: expectation-maximisation finds the
language proportions under which its n-grams are likeliest. The languages of a document are
selected by penalised likelihood: those of the full fit are added one by one, most likely
first, as long as the likelihood rises by more than the penalty. The largest proportion among
the selected is the prediction, and that proportion its score.

The model is a table of languages by cells. Its size depends on neither; only the number of
languages is data, and more than ``MAX_LANGUAGES`` of them are an error. Counts are combined
in the tasks, then by Spark; the driver gets the sums.

Null and blank texts, or texts without a letter, are ``und`` with score 0. Rows without a
language aren't learned from. Without any training row every text is ``und``. Rows with one
id are predicted one by one; equal proportions go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
MAX_LANGUAGES = 512
UNKNOWN = "und"
SMOOTHING = 0.3
STEPS = 40
TOLERANCE = 1e-3
# Overlapping n-grams carry less than one observation each.
GRAMS_PER_CHARACTER = len(GRAMS)
# Texts are read in pieces of so many characters, and on to the next white space, which bounds the memory of one step.
PIECE = 1 << 20
SPACE = re.compile(r"\s")


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_cells(text: str) -> np.ndarray:
    """Cells of all n-grams within words, each word between two spaces; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    plain = np.where(letter, codes, 32)
    keep = letter | np.concatenate([[True], letter[:-1]])  # one space after a word
    plain = np.concatenate([[32], plain[keep], [32]]).astype(np.uint64)
    out = []
    key = np.zeros(len(plain), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        key = (key[: len(plain) - n + 1] * np.uint64(1_000_003)) ^ plain[n - 1 :]
        if n in GRAMS:
            inside = plain[n // 2 : len(plain) - n + 1 + n // 2] != 32  # the middle is a letter
            mixed = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(48))[inside])
    return np.concatenate(out).astype(np.int64)


def count_cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a text and how often each stands."""
    if len(text) <= 20_000:
        return np.unique(gram_cells(text), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    start = 0
    while start < len(text):  # no n-gram and no lower case looks across white space
        space = SPACE.search(text, start + PIECE)
        end = space.start() if space else len(text)
        total += np.bincount(gram_cells(text[start:end]), minlength=BUCKETS)
        start = end
    cells = np.flatnonzero(total)
    return cells, total[cells]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, cell, n) over all (lang, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells, counts = count_cells(text.as_py())
                if lang not in sums:
                    if len(sums) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang][cells] += counts
        for lang, total in sums.items():
            cells = np.flatnonzero(total)
            columns = [pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(total[cells])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "cell", "n"])

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return known.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Likelihoods by [cell, language]."""

    languages: list[str]
    likelihood: np.ndarray

    def proportions(self, cells: np.ndarray, counts: np.ndarray, among: list[int]) -> tuple[np.ndarray, float]:
        """Proportions of the given languages by expectation-maximisation, and their log-likelihood."""
        p = self.likelihood[np.ix_(cells, among)]
        weight = counts.astype(np.float64)
        total = weight.sum()
        share = np.full(len(among), 1.0 / len(among))
        mixed = p @ share
        for _ in range(STEPS if len(among) > 1 else 0):
            new = share * ((weight / mixed) @ p) / total
            moved = np.abs(new - share).max()
            share = new
            mixed = p @ share
            if moved < TOLERANCE:
                break
        return share, float(weight @ np.log(mixed))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        cells, counts = count_cells(text)
        if not len(cells):
            return UNKNOWN, 0.0
        everything, _ = self.proportions(cells, counts, list(range(len(self.languages))))
        order = sorted(range(len(everything)), key=lambda i: (-everything[i], i))
        penalty = 2.0 * GRAMS_PER_CHARACTER * np.log(counts.sum() + 1.0)
        chosen, (share, best) = order[:1], self.proportions(cells, counts, order[:1])
        for more in order[1:]:
            if everything[more] < TOLERANCE:
                break
            wider, likely = self.proportions(cells, counts, [*chosen, more])
            if likely - best <= penalty:
                break
            chosen, share, best = [*chosen, more], wider, likely
        top = min(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
        return self.languages[chosen[top]], float(min(share[top], 1.0))


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Likelihoods from all (lang, text) rows."""
    rows = count_grams(docs).toArrow().to_pandas()  # at most MAX_LANGUAGES times BUCKETS sums
    languages = sorted(rows["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    number = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, (rows["cell"].to_numpy(), rows["lang"].map(number).to_numpy(np.int64)), rows["n"].to_numpy(np.float64))
    return LanguageModel(languages, (counts / counts.sum(0)).astype(np.float64))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(id, lang_pred, score) of (id, text) rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, lang_pred string, score double")
