"""Queries of the operators that match texts with each other or with a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasonde.llm import decontaminate, ngram_join, simhash
from datasonde.llm.registry import query, table

WINDOW_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as width, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as body
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from items where len(w) > 0)
), widths as (
  select distinct width from windows
), slices as (
  select doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') as body
  from (select doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) as i from words, widths where len(w) >= width)
), found as (
  select s.doc_id, s.i, s.width, x.item_id from slices s join windows x on x.width = s.width and x.body = s.body
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + width - 1)) as p from found) group by doc_id
), held as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
       coalesce(i.items_sha256, sha256('')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from words w left join hit h using (doc_id) left join held i using (doc_id)
"""


@query("op9_decontamination", WINDOW_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    rows = decontaminate.contamination(docs, items)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op3_simhash")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), "text")
    rows = simhash.near_duplicates(docs, words_per_shingle=4, most=4)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op12_ngram_join")
def ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = ngram_join.joined(docs)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
