"""Quality rules: boosted trees over document statistics, with fixed base rules in front.

The trees are fitted to labelled rows only, at most ``MAX_LABELLED`` of them chosen by hash:
their texts are measured by the tasks, and a few numbers for each row go to the driver. They
are flattened to node arrays of fixed size, and one pass then measures and scores every whole
text, batch by batch, without a shuffle.

The verdict can't rise with the share of symbols, repeated lines or repeated words, nor fall
with the share of distinct words, whatever the labels say of a corner of the data.

A missing or empty text has no words and fails the base rules, as does any text of fewer than
20 words. Labels may be missing, or be all of one kind: then the base rules and a constant
decide. Rows with one id are measured one by one; if an id has several labels the highest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasonde.llm.boosting import FlatTrees, fit_trees
from datasonde.llm.text_stats import BASE, SHAPE, hash_sample, measured, shape_matrix, shapes

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LABELLED = 30_000
KEEP_FROM = 0.5
# The score falls (-1) or rises (+1) with these.
MONOTONE = {"symbol_share": -1, "pipe_share": -1, "shout_share": -1, "dup_line_share": -1, "repeat_share": -1, "echo_share": -1, "top_word_share": -1, "distinct_share": 1}


def fit_rules(docs: DataFrame, labels: DataFrame, at_most: int = MAX_LABELLED) -> FlatTrees:
    """Trees from (id, text) rows and (id, label) rows with labels 0 and 1."""
    known = labels.filter(F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    sample = F.broadcast(hash_sample(known, at_most, "rules"))  # at_most rows
    rows = shapes(docs.join(sample.filter("label = 1"), "id", "left_semi")), shapes(docs.join(sample.filter("label = 0"), "id", "left_semi"))
    good, bad = map(shape_matrix, rows)
    constraints = {SHAPE.index(name): way for name, way in MONOTONE.items()}
    return fit_trees(np.vstack([good, bad]), np.repeat([1.0, 0.0], [len(good), len(bad)]), constraints)


def judge(docs: DataFrame, model: FlatTrees, keep_from: float = KEEP_FROM) -> DataFrame:
    """(id, base counts, score, base_failed, kept) for (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, shape = measured(batch.column(1))
            columns = [batch.column(0), *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(model.probability(shape))]
            yield pa.RecordBatch.from_arrays(columns, ["id", *BASE, "score"])

    kind = docs.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{c} long" for c in BASE), "score double"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = docs.select("id", "text").mapInArrow(run, schema).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_from))


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, base counts, score, base_failed, kept) of every document; labels are (id, label) rows."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return judge(rows, fit_rules(rows, labels))
