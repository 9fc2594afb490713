import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from datasonde.functions.shared import stored
from datasonde.llm import simhash
from datasonde.llm.decontaminate import contamination
from datasonde.llm.queries import ORACLES, QUERIES
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert QUERIES["pipeline"] is corpus_pipeline.run and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op7_url_filter", "op8_mixing", "op9_decontamination", "op11_filter_audit"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"  # labels enough to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes, outputs = [docs.count()], []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
        outputs.append(docs)
        sizes.append(docs.count())
        assert name == "mixing" or docs.columns == columns
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2] and sizes[4] < sizes[3]
    good, lines, single, clean, mixed = outputs
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = good.join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r.quality: r["count"] for r in kept}.get(0, 0) <= 2

    def rows(df):
        return df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), "text")

    found = simhash.near_duplicates(rows(single), words_per_shingle=4, most=4)
    assert found.select("root").distinct().count() == single.count()
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("item"), "text")
    assert contamination(rows(clean), benchmark).filter("contaminated").count() == 0
    dirty = contamination(rows(single), benchmark).filter("contaminated").count()
    assert clean.count() == single.count() - dirty
    assert mixed.columns == [*columns, "copy"] and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert lines.select(F.sum((F.length("text") != F.col("n_chars")).cast("int"))).first()[0] == 0


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= 2 * docs.count()
