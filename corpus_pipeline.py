"""From raw documents to a training mixture, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet
and read again as the docs of the next one. All stages but the last return the columns of
documents; the mixture also has the number of the copy.

Every stage takes any rows: columns may be null, further columns are kept whatever their names,
rows may repeat and tables may be empty, which gives an empty result. A missing or empty text
has no words, lines or shingles; texts of any length are read whole. What a stage does with ties
and with rows of one id is told at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasonde.functions.shared import stored
from datasonde.llm.columns import remainder
from datasonde.llm.decontaminate import decontaminated
from datasonde.llm.line_dedup import dedup_lines
from datasonde.llm.mixing import mix
from datasonde.llm.pu_quality import PREDICT_FROM, fit_quality, quality_score
from datasonde.llm.simhash import without_near_duplicates

# No stage can be told in SQL as a whole: the first learns a classifier.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from trusted positives and unlabelled text, doesn't reject.

    A missing or empty text is scored like any other, a score equal to the threshold is kept, and
    equal texts share their fate. Without labels to learn from nothing is rejected.
    """
    trained = remainder(F.col("id"), 5) != 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    model = fit_quality(rows, labels.filter(trained & (F.col("quality") == 1)), trained)
    return docs.filter(quality_score(model)(F.col("text")) >= PREDICT_FROM)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of passages that an earlier document or place has.

    Earlier is the smaller id, a missing one last; equal ids are told apart by their text. All
    documents stay, some with fewer lines or an empty text; a missing text stays missing.
    """
    return dedup_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints of four-word shingles at most four bits apart.

    The smallest id stays, a missing one only where a group has no other; of rows of one id the
    smallest hash of the text, of equal rows any one. Texts without a word make one group.
    """
    return without_near_duplicates(docs, words_per_shingle=4, most=4)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Each row is judged by its own text; a missing or wordless text is clean, and so is everything
    beside an empty benchmark.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources come to their target weights.

    A missing source is one source, the last. A document without words has size 0; rows of one id
    share a draw, so equal rows are repeated equally.
    """
    return mix(docs)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", unrepeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", uncontaminated),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
