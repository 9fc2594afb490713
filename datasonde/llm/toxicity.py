"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, report, clause end, other. Small
transducers each follow one thing through a clause: whether a negation stands within the last
words, whether the clause reports what someone said, whether someone is addressed. Their
composition, a product machine built once, emits for each insult or threat the context it
stands in; its weight, times that of the word, is summed over the clause. Clauses are what is
scored: a document's score is a logistic function of its strongest clause, the sum and the
number of its matched clauses, and the same for threats.

Insults are learned: words and word beginnings that many texts labelled toxic hold, and hardly
any clean one. A text counts by the place where the word first stands, told by the words
around it, so that a thousand copies of one text count once, and so does a long text. The words
of threat, target, negation and report are closed lists. The fit reads at most ``MAX_TOXIC`` and
``MAX_CLEAN`` labelled rows, chosen by hash. The logistic weights are fitted on one half of them
with words learned from the other; then words are learned anew from both. Counting is done by
the tasks; the driver gets the words that pass, and a few numbers for each row.

A missing or empty text has no clause and the lowest score. Rows with one id are scored one by
one. Without labels nothing is an insult; threats still score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasonde.functions.shared import stored
from datasonde.llm.text_stats import hash_sample

MAX_TOXIC = 10_000
MAX_CLEAN = 20_000
MAX_TERMS = 5_000
SAMPLE_TASKS = 24
MIN_PLACES = 4
MIN_LOG_ODDS = 3.0
# A beginning counts only if it starts so many different words.
MIN_ENDINGS = 3
PREFIXES = (4, 5, 6, 7)
PREDICT_FROM = 0.7

# Fixed word lists: English, French, German, Spanish.
THREATS = "kill hurt destroy murder stab shoot tuer frapper détruire töten schlagen zerstören matar golpear destruir"
TARGETS = "you your yours they them he she tu toi vous ton votre du dich dein euch ihr sie usted ustedes tú ti"
NEGATIONS = "not no never neither nor without ne pas jamais sans nicht kein keine nie ohne nunca sin"
REPORTS = "said says say told called wrote quoted reported dit disait écrit selon sagte schrieb laut dijo escribió según"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (next state, mark). Symbols it doesn't name keep the state, mark 0."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int]]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, 0))


def negation(reach: int = 3) -> Transducer:
    """Marks insults and threats that stand at most ``reach`` words after a negation."""
    arcs = {}
    for s in range(reach + 1):
        after = max(s - 1, 0)
        for symbol in (OTHER, TARGET, REPORT):
            arcs[s, symbol] = (after, 0)
        for symbol in (INSULT, THREAT):
            arcs[s, symbol] = (after, int(s > 0))
        arcs[s, NEGATION] = (reach, 0)
        arcs[s, END] = (0, 0)
    return Transducer(reach + 1, arcs)


def within_clause(opener: int) -> Transducer:
    """Marks insults and threats after ``opener`` in the same clause."""
    arcs = {(s, opener): (1, 0) for s in (0, 1)} | {(s, END): (0, 0) for s in (0, 1)}
    arcs |= {(s, symbol): (s, s) for s in (0, 1) for symbol in (INSULT, THREAT)}
    return Transducer(2, arcs)


@dataclass(frozen=True)
class Machine:
    """The composition: next state and weight by [state, symbol]."""

    next: np.ndarray
    weight: np.ndarray

    def clauses(self, symbols: list[int], weights: list[float]) -> tuple[list[float], list[float]]:
        """Scores of the clauses that hold an insult, and of those that hold a threat."""
        state, found = 0, {INSULT: 0.0, THREAT: 0.0}
        scores: dict[int, list[float]] = {INSULT: [], THREAT: []}
        for symbol, weight in zip([*symbols, END], [*weights, 0.0]):
            if symbol in found:
                found[symbol] += weight * self.weight[state, symbol]
            elif symbol == END:
                for kind, total in found.items():
                    if total:
                        scores[kind].append(total)
                    found[kind] = 0.0
            state = self.next[state, symbol]
        return scores[INSULT], scores[THREAT]


def compose(parts: list[Transducer], factors: list[float], bare: dict[int, float]) -> Machine:
    """The product of the parts; a mark of part i multiplies the weight of the symbol by factors[i]."""
    states = list(product(*(range(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    after, weight = np.zeros((len(states), END + 1), np.int64), np.zeros((len(states), END + 1))
    for s, symbol in product(states, range(END + 1)):
        steps = [p.step(x, symbol) for p, x in zip(parts, s)]
        after[number[s], symbol] = number[tuple(to for to, _ in steps)]
        weight[number[s], symbol] = bare.get(symbol, 0.0) * float(np.prod([f if mark else 1.0 for f, (_, mark) in zip(factors, steps)]))
    return Machine(after, weight)


def grammar() -> Machine:
    """Negated counts 0.3, reported 0.5, addressed 1.5; a threat counts little unless someone is addressed."""
    return compose([negation(), within_clause(REPORT), within_clause(TARGET)], [0.3, 0.5, 1.5], {INSULT: 1.0, THREAT: 0.5})


FEATURES = ("strongest", "total", "clauses", "threat")


@dataclass
class ToxicModel:
    """Words and beginnings with their weights, and the logistic weights of ``FEATURES``."""

    terms: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 0.0, 0.0, 1.0]))

    def reader(self):
        """A function text -> features; it remembers the symbols of words."""
        closed = {w: kind for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words.split()}
        closed |= dict.fromkeys(".!?;:\n", END)
        model, machine = self, grammar()

        class Symbols(dict):
            def __missing__(self, word: str) -> tuple[int, float]:
                if len(self) > 300_000:
                    self.clear()
                kind = closed.get(word, OTHER)
                found = (kind, 1.0 if kind == THREAT else 0.0)
                if kind == OTHER:
                    weight = max([model.terms.get(word, 0.0), *(model.beginnings.get(word[:k], 0.0) for k in PREFIXES if len(word) > k)])
                    found = (INSULT, weight) if weight else found
                self[word] = found
                return found

        symbols = Symbols()

        def features(text: str | None) -> list[float]:
            codes = [symbols[w] for w in TOKEN.findall((text or "").lower())]
            if not any(weight for _, weight in codes):
                return [0.0] * len(FEATURES)
            insults, threats = machine.clauses([c for c, _ in codes], [w for _, w in codes])
            return [max(insults, default=0.0), float(np.log1p(sum(insults))), float(np.log1p(len(insults))), float(np.log1p(sum(threats)))]

        return features

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.coefficients[0] + features @ self.coefficients[1:])))


def _beginnings(word: str) -> list[str]:
    return [word[:k] + "-" for k in PREFIXES if len(word) > k]


def _toxic_words(docs: DataFrame) -> DataFrame:
    """(half, word, leads, n): in how many places the words of (half, text) rows first stand in a text.

    A place is told by the words around it; a text gives one row for each of its words. Bit i of
    ``leads`` says that the word is the text's first one with its beginning of ``PREFIXES[i]`` letters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for half, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = TOKEN.findall((text.as_py() or "").lower())
                known: set[str] = set()
                for i, word in enumerate(words):
                    if len(word) < 2 or word in known:
                        continue
                    starts = [word[:k] + "-" if len(word) > k else "" for k in PREFIXES]
                    leads = sum(1 << b for b, start in enumerate(starts) if start and start not in known)
                    known.update((word, *starts))
                    around = " ".join(words[max(i - 2, 0) : i] + words[i + 1 : i + 3])
                    for column, value in zip(rows, (half, word, leads, zlib.crc32(around.encode()))):
                        column.append(value)
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["half", "word", "leads", "place"])

    places = docs.select("half", "text").mapInArrow(run, "half int, word string, leads int, place long").distinct()
    return places.groupBy("half", "word", "leads").agg(F.count(F.lit(1)).alias("n"))


def _clean_units(docs: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(half, unit, n): how many clean texts hold the wanted words and beginnings; counted by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[int, str]] = Counter()
            for half, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = set(TOKEN.findall((text.as_py() or "").lower()))
                units = words.union(*map(_beginnings, words)) & wanted
                counts.update((half, u) for u in units)
            halves, units = zip(*counts) if counts else ((), ())
            columns = [pa.array(halves, pa.int32()), pa.array(units, pa.string()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["half", "unit", "n"])

    return docs.select("half", "text").mapInArrow(run, "half int, unit string, n long").groupBy("half", "unit").agg(F.sum("n").alias("n"))


def _toxic_units(words: DataFrame) -> DataFrame:
    """(unit, n0, n1): words, and beginnings of ``MIN_ENDINGS`` words, that stand in enough places of both halves together."""
    sums = [F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)]
    starts = [F.when(F.col("leads").bitwiseAND(1 << b) > 0, F.concat(F.substring("word", 1, k), F.lit("-"))) for b, k in enumerate(PREFIXES)]
    starts = words.select(F.explode(F.array(*starts)).alias("unit"), "word", "half", "n").filter(F.col("unit").isNotNull())
    starts = starts.groupBy("unit").agg(*sums, F.approx_count_distinct("word").alias("words"))  # exact for so few
    units = words.groupBy(F.col("word").alias("unit")).agg(*sums).unionByName(starts.filter(F.col("words") >= MIN_ENDINGS).drop("words"))
    return units.filter(F.col("n0") + F.col("n1") >= MIN_PLACES)


def learn_terms(rows: DataFrame, texts: dict[tuple[int, int], int]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights (log odds of a toxic text) of the units that mark toxic texts, from the first half and from both.

    ``rows`` has (label, half, text), ``texts`` the number of rows by (label, half). The driver gets the
    names of the units, which the sample bounds, as each stands in MIN_PLACES places, and at most
    ``MAX_TERMS`` weights each.
    """
    toxic = stored(_toxic_units(_toxic_words(rows.filter("label = 1"))))
    names = frozenset(toxic.select("unit").toArrow().column(0).to_pylist())
    by_half = [F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"c{h}") for h in (0, 1)]
    clean = _clean_units(rows.filter("label = 0"), names).groupBy("unit").agg(*by_half)
    both = stored(toxic.join(clean, "unit", "left").fillna(0, ["c0", "c1"]))

    def weights(halves: tuple[int, ...]) -> dict[str, float]:
        n_toxic, n_clean = (sum(texts.get((k, h), 0) for h in halves) + 1 for k in (1, 0))
        places, holds = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in "nc")
        odds = F.log((places + 0.5) / n_toxic) - F.log((holds + 0.5) / n_clean)
        strong = both.filter(places >= MIN_PLACES).select("unit", odds.alias("weight")).filter(F.col("weight") >= MIN_LOG_ODDS)
        return {r.unit: r.weight for r in strong.orderBy(F.desc("weight"), "unit").limit(MAX_TERMS).collect()}

    return weights((0,)), weights((0, 1))


def _features(docs: DataFrame, model: ToxicModel, label: bool = False) -> DataFrame:
    more = ["label"] if label else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in batches:
            rows = np.array([read(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(FEATURES))
            columns = [batch.column(0), *([batch.column(2)] if label else []), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", *more, *FEATURES])

    kind = docs.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{c} int" for c in more), *(f"{c} double" for c in FEATURES)])
    return docs.select("id", "text", *more).mapInArrow(run, schema)


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float = 0.02) -> np.ndarray:
    """Newton steps for logistic weights, pulled towards ``prior``; both classes weigh as their counts."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = prior.copy()
    strength = pull * max(len(y), 1) / 100
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + strength * (w - prior)
        hess = (z * (p * (1 - p))[:, None]).T @ z + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max())
    return w


def _model(units: dict[str, float]) -> ToxicModel:
    return ToxicModel({u: w for u, w in units.items() if u[-1] != "-"}, {u[:-1]: w for u, w in units.items() if u[-1] == "-"})


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicModel:
    """Fit on (id, text) rows and (id, label) rows with labels 0 and 1."""
    known = labels.filter(F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").cast("int").alias("label"))
    parts = [hash_sample(known.filter(F.col("label") == k), most, "toxicity") for k, most in ((1, max_toxic), (0, max_clean))]
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("id")), F.lit(2)).cast("int")
    sample = parts[0].unionByName(parts[1]).withColumn("half", half)
    counts = {(r.label, r.half): r.n for r in sample.groupBy("label", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = docs.join(F.broadcast(sample), "id")  # max_toxic + max_clean rows, read several times
    rows = stored(rows.repartition(SAMPLE_TASKS, "id"))

    first, both = (_model(units) for units in learn_terms(rows, counts))
    found = sorted(tuple(r) for r in _features(rows.filter("half = 1"), first, label=True).select("label", *FEATURES).collect())
    table = np.array(found, np.float64).reshape(-1, len(FEATURES) + 1)
    model = both
    if len(table):
        fitted = _logistic(table[:, 1:], table[:, 0], model.coefficients)
        model.coefficients = np.concatenate([fitted[:1], np.maximum(fitted[1:], 0.0)])  # no pattern makes a text less toxic
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(id, score) of (id, text) rows, in one pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in batches:
            rows = np.array([read(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(rows))], ["id", "score"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, score double")
