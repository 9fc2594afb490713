"""The query of the token totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasonde.functions.shared import shared_folder, stored
from datasonde.llm.columns import word_count
from datasonde.llm.registry import query, table
from datasonde.llm.token_counts import TokenLedger, count_tokens, deletes, inserts, revisions

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BPE, WORDS = "byte_bpe_50k", "words"
# The corrected rule for words: a word needs a letter or a digit.
SPOKEN = r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*"


@query("op10_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents.

    All documents come in with their byte-pair tokens and their words; the same batch comes a
    second time and changes nothing; word counts are revised to the corrected rule; and the
    documents that ``labels`` marks toxic are deleted, under both versions.
    """
    docs = table(spark, sf_dir, "documents")
    corrected = F.coalesce(F.regexp_count("text", F.lit(SPOKEN)), F.lit(0)).cast("long")
    counted = stored(count_tokens(docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("words"), corrected.alias("spoken"), "text"), RANKS_FILE, "bpe"))
    bpe = counted.select("doc_id", "source", "lang", F.lit(BPE).alias("version"), F.col("bpe").alias("tokens"))
    words = counted.select("doc_id", "source", "lang", F.lit(WORDS).alias("version"), F.col("words").alias("old_tokens"), F.col("spoken").alias("tokens"))
    first = words.withColumn("tokens", F.col("old_tokens")).select(bpe.columns)
    loaded = bpe.unionByName(first)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    gone = bpe.unionByName(words.select(bpe.columns)).join(toxic, "doc_id", "left_semi")

    ledger = TokenLedger(spark, shared_folder(spark))
    ledger.commit("load", inserts(loaded))
    ledger.commit("load", inserts(loaded))
    ledger.commit("word rule", revisions(words.filter("tokens <> old_tokens")))
    ledger.commit("toxic documents", deletes(gone))
    return ledger.totals()
