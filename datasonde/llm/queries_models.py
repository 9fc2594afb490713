"""Queries of the operators that learn; each is checked on held-out rows or by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasonde.llm import language_id, pu_quality, quality_rules, toxicity
from datasonde.llm.columns import remainder
from datasonde.llm.registry import query, table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col(name).alias("label"))


def _scored(rows: DataFrame, divisor: int, held: int, predict_from: float) -> DataFrame:
    return rows.select(
        F.col("id").alias("doc_id"),
        (remainder(F.col("id"), divisor) == held).alias("held_out"),
        "score",
        (F.col("score") >= predict_from).cast("int").alias("predicted"),
    )


@query("op1_language_id")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_languages(docs.filter(remainder(F.col("doc_id"), 4) != 2).select("lang", "text"))
    found = language_id.predict_languages(_texts(spark, sf_dir), model)
    held = (remainder(F.col("id"), 4) == 2).alias("held_out")
    return found.select(F.col("id").alias("doc_id"), held, "lang_pred", "score")


@query("op4_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    known = _labels(spark, sf_dir, "toxic").filter(remainder(F.col("id"), 3) != 1)
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, known))
    return _scored(rows, 3, 1, toxicity.PREDICT_FROM)


@query("op5_quality_classifier")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    trained = remainder(F.col("id"), 5) != 0
    positives = _labels(spark, sf_dir, "quality").filter(trained & (F.col("label") == 1))
    rows = pu_quality.score_quality(docs, pu_quality.fit_quality(docs, positives, trained))
    return _scored(rows, 5, 0, pu_quality.PREDICT_FROM)


@query("op6_quality_rules")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "quality"))
    return rows.withColumnRenamed("id", "doc_id")
