"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled web text are enough: no negative label is used. With the
class prior pi, the share of good text among the unlabelled, and the loss l, the risk

    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

is that of a classifier trained on good and bad text; the maximum keeps its second part, the
risk on bad text, from going below zero as the network fits the positives by heart.

The prior is estimated from the same two samples. Ranked by a first classifier of positive
against unlabelled, the unlabelled above a cut hold at least pi times the share of positives
above it, with equality where no bad text reaches. So the smallest ratio over all cuts, with
an allowance for small counts, is the estimate.

The two samples are bounded (``MAX_POSITIVES``, ``MAX_UNLABELLED`` rows chosen by hash); a few
numbers for each row go to the driver. One pass then scores every whole text without a shuffle.

A missing text, or one without a word, scores 0. Without a positive or an unlabelled row,
every text with a word scores the prior of 0.5. Rows with one id are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasonde.llm.text_stats import hash_sample, measured, shape_matrix, shapes

MAX_POSITIVES = 20_000
MAX_UNLABELLED = 40_000
HIDDEN = 16
BATCH = 500
STEPS = 1_000
STEP = 0.01
PREDICT_FROM = 0.3


@dataclass
class Net:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def hidden(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w1 + self.b1)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(self.standard(x)) @ self.w2 + self.b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(g / 2))


def _train(pos: np.ndarray, unl: np.ndarray, slopes, seed: int = 7) -> Net:
    """Adam over mini-batches; ``slopes`` gives the risk's slope in the margins of a batch of each sample."""
    rng = np.random.default_rng(seed)
    both = np.vstack([pos, unl])
    scale = both.std(0)
    net = Net(both.mean(0), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 0.3, (pos.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1))
    zp, zu = net.standard(pos), net.standard(unl)
    weights = [net.w1, net.b1, net.w2, net.b2]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    parts = max(1, len(zp) // BATCH)  # small batches would make the bound of the risk noisy
    epochs = max(1, STEPS // parts)
    for epoch in range(epochs):
        rate = STEP * (1 - epoch / epochs) + 1e-4
        for ip, iu in zip(np.array_split(rng.permutation(len(zp)), parts), np.array_split(rng.permutation(len(zu)), parts)):
            z = np.vstack([zp[ip], zu[iu]])
            h = net.hidden(z)
            g = h @ net.w2 + net.b2[0]
            slope = slopes(g[: len(ip)], g[len(ip) :])
            back = np.outer(slope, net.w2) * (1 - h**2)
            grads = [z.T @ back + 1e-4 * net.w1, back.sum(0), h.T @ slope + 1e-4 * net.w2, np.array([slope.sum()])]
            t += 1
            for w, m, v, d in zip(weights, first, second, grads):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among the unlabelled, from two samples of features."""

    def apart(gp: np.ndarray, gu: np.ndarray) -> np.ndarray:
        return np.concatenate([-_sigmoid(-gp) / (2 * len(gp)), _sigmoid(gu) / (2 * len(gu))])

    net = _train(pos[::2], unl[::2], apart)
    gp, gu = np.sort(net.margin(pos[1::2])), np.sort(net.margin(unl[1::2]))
    if not len(gp) or not len(gu):
        return 0.5
    cuts = np.quantile(gp, np.linspace(0, 0.95, 96))
    above_p = 1 - np.searchsorted(gp, cuts, "left") / len(gp)
    above_u = 1 - np.searchsorted(gu, cuts, "left") / len(gu)
    slack = np.sqrt(np.log(40) / (2 * len(gu))) + np.sqrt(np.log(40) / (2 * len(gp)))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def non_negative_slopes(prior: float):
    """Slopes of the non-negative risk; where the risk on bad text falls below zero, it is pushed back up."""

    def slopes(gp: np.ndarray, gu: np.ndarray) -> np.ndarray:
        up = _sigmoid(gu) / len(gu)  # slope of E_u[l(-g)]
        back = prior * _sigmoid(gp) / len(gp)  # slope of pi E_p[l(-g)]
        bad = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if bad < 0:
            return np.concatenate([back, -up])
        return np.concatenate([-prior * _sigmoid(-gp) / len(gp) - back, up])

    return slopes


@dataclass
class PuModel:
    prior: float
    net: Net | None

    def score(self, base: np.ndarray, shape: np.ndarray) -> np.ndarray:
        found = np.full(len(base), self.prior) if self.net is None else self.net.probability(shape)
        return np.where(base[:, 0] > 0, found, 0.0)


def fit_matrices(pos: np.ndarray, unl: np.ndarray) -> PuModel:
    if len(pos) < 2 or len(unl) < 2:
        return PuModel(0.5, None)
    prior = estimate_prior(pos, unl)
    return PuModel(prior, _train(pos, unl, non_negative_slopes(prior)))


def fit_quality(docs: DataFrame, positives: DataFrame, unlabelled: Column, at_most: tuple[int, int] = (MAX_POSITIVES, MAX_UNLABELLED)) -> PuModel:
    """Fit on (id, text) rows: the ids of ``positives``, and the rows where ``unlabelled`` holds."""
    known = F.broadcast(hash_sample(positives.select("id").distinct(), at_most[0], "positives"))  # at_most[0] ids
    pos = shape_matrix(shapes(docs.join(known, "id", "left_semi")))
    unl = shape_matrix(shapes(hash_sample(docs.filter(unlabelled), at_most[1], "unlabelled")))
    rng = np.random.default_rng(11)
    return fit_matrices(rng.permutation(pos), rng.permutation(unl))


def quality_score(model: PuModel):
    """A column function text -> score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(*measured(pa.array(texts, pa.large_string(), from_pandas=True))))

    return score


def score_quality(docs: DataFrame, model: PuModel) -> DataFrame:
    """(id, score) for (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(*measured(batch.column(1))))], ["id", "score"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, score double")
