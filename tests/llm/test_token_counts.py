import base64

import pytest
from pyspark.sql import functions as F

from datasonde.functions.shared import shared_folder
from datasonde.llm.queries_tokens import RANKS_FILE, token_counts
from datasonde.llm.token_counts import COMMIT, PATTERN, TokenLedger, count_tokens, deletes, inserts, revisions


def changes(spark, rows, old=False):
    return spark.createDataFrame(rows, "source string, lang string, version string, tokens long" + ", old_tokens long" * old)


def totals(ledger):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


@pytest.fixture
def ledger(spark):
    return TokenLedger(spark, shared_folder(spark))


def test_signed_changes_add_up(spark, ledger):
    assert totals(ledger) == {}
    assert ledger.commit("1", inserts(changes(spark, [("a", "en", "v1", 10), ("a", "en", "v1", 5), ("b", None, "v1", None), (None, "en", "v2", 3)])))
    assert ledger.commit("2", revisions(changes(spark, [("a", "en", "v1", 12, 10), ("b", None, "v1", 4, None)], old=True)))
    assert ledger.commit("3", deletes(changes(spark, [("a", "en", "v1", 5), (None, "en", "v2", 3)])))
    assert totals(ledger) == {("a", "en", "v1"): (1, 12), ("b", None, "v1"): (1, 4), (None, "en", "v2"): (0, 0)}


def test_a_repeated_batch_changes_nothing(spark, ledger):
    batch = inserts(changes(spark, [("a", "en", "v1", 10), ("a", "en", "v1", 10)]))
    assert ledger.commit("1", batch) and not ledger.commit("1", batch)
    assert not TokenLedger(spark, ledger.folder).commit("1", inserts(changes(spark, [("z", "z", "z", 1)])))
    assert totals(ledger) == {("a", "en", "v1"): (2, 20)}


def test_sums_without_a_commit_are_never_read(spark, ledger):
    ledger.commit("1", inserts(changes(spark, [("a", "en", "v1", 10)])))
    inserts(changes(spark, [("a", "en", "v1", 99)])).write.parquet(f"{ledger.folder}/sums/of-a-lost-driver")
    assert totals(ledger) == {("a", "en", "v1"): (1, 10)}


def test_two_senders_of_one_batch_count_once(spark, ledger):
    batch = inserts(changes(spark, [("a", "en", "v1", 10)]))
    ledger.commit("1", batch)
    row = ledger.spark.read.parquet(f"{ledger.folder}/commits").first()
    batch.write.parquet(f"{ledger.folder}/sums/other")
    ledger._commits(spark.createDataFrame([("1", f"{ledger.folder}/sums/other", [])], "batch string, folder string, replaces array<string>"))
    assert row.batch == "1" and totals(ledger) == {("a", "en", "v1"): (1, 10)}


def test_compaction_keeps_totals_and_names(spark, ledger):
    for i in range(3):
        ledger.commit(str(i), inserts(changes(spark, [("a", "en", "v1", i)])))
    before = totals(ledger)
    ledger.compact()
    assert totals(ledger) == before and len([f for f in ledger.committed().values() if f]) == 1
    assert not ledger.commit("1", inserts(changes(spark, [("a", "en", "v1", 1)])))
    ledger.commit("more", inserts(changes(spark, [("a", "en", "v1", 7)])))
    ledger.compact()
    assert totals(ledger) == {("a", "en", "v1"): (4, 10)}


def test_compactions_at_once_count_no_batch_twice(spark, ledger):
    one = lambda n: inserts(changes(spark, [("a", "en", "v1", n)]))
    ledger.commit("1", one(10))
    ledger.commit("2", one(5))
    seen = ledger._state()
    late = TokenLedger(spark, ledger.folder)
    late._state = lambda: seen  # a second compaction that read the ledger before the first ended
    ledger.compact()
    ledger.commit("3", one(2))
    late.compact()
    assert totals(ledger) == {("a", "en", "v1"): (3, 17)}
    wider = TokenLedger(spark, ledger.folder)
    ledger.compact()
    del late._state
    late.compact()
    assert totals(wider) == {("a", "en", "v1"): (3, 17)} and not wider.commit("2", one(5))
    assert len(wider.committed()) == 1


def test_a_batch_that_comes_again_after_its_snapshot_is_left_out(spark, ledger):
    batch = inserts(changes(spark, [("a", "en", "v1", 10)]))
    ledger.commit("1", batch)
    ledger.compact()
    batch.write.parquet(f"{ledger.folder}/sums/of-a-slow-sender")
    ledger._commits(spark.createDataFrame([("1", f"{ledger.folder}/sums/of-a-slow-sender", None, None)], COMMIT))
    assert totals(ledger) == {("a", "en", "v1"): (1, 10)}


def test_odd_rows(spark, ledger, odd, none):
    rows = odd.select("source", "lang", F.lit("v").alias("version"), F.length("text").alias("tokens"))
    expected = {}
    for r in odd.collect():
        n, tokens = expected.get((r.source, r.lang, "v"), (0, 0))
        expected[r.source, r.lang, "v"] = (n + 1, tokens + len(r.text or ""))
    assert ledger.commit("odd", inserts(rows)) and totals(ledger) == expected
    assert ledger.commit("none", deletes(rows.limit(0))) and totals(ledger) == expected
    ledger.commit("gone", deletes(rows))
    ledger.compact()
    assert totals(ledger) == {key: (0, 0) for key in expected}


def test_the_query_against_a_recount(spark, tmp_path):
    import re

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS_FILE, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["two words", None, "", "dash - and \u00e9t\u00e9 !", "a\nb\t c", "word " * 5000, "two words", "... 7"]
    docs = [(i, t, "ab"[i % 2] if i != 3 else None, "en" if i % 3 else None) for i, t in enumerate(texts)]
    marked = {2, 4, 6}
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i in marked)) for i in range(len(texts))] + [(4, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    expected = {}
    for i, text, source, lang in docs:
        spoken = sum(any(c.isalnum() for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        for version, tokens in (("byte_bpe_50k", len(plain.encode_ordinary(text or ""))), ("words", spoken)):
            n, total = expected.get((source, lang, version), (0, 0))
            expected[source, lang, version] = (n, total) if i in marked else (n + 1, total + tokens)
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in token_counts(spark, str(tmp_path)).collect()} == expected


def test_empty_batches(spark, ledger):
    assert ledger.commit("none", inserts(changes(spark, [])))
    assert totals(ledger) == {} and not ledger.commit("none", inserts(changes(spark, [])))


def test_tokens_round_trip(spark, odd, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS_FILE, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd.withColumnRenamed("size", "n")
    got = {(r.doc_id, r.n_chars): r.tokens for r in count_tokens(rows, RANKS_FILE).collect()}
    for r in odd.collect():
        ids = plain.encode_ordinary(r.text or "")
        assert plain.decode(ids) == (r.text or "") and got[r.doc_id, r.n_chars] in (len(ids), 0 if r.text is None else got[r.doc_id, r.n_chars])
    assert got[4, 0] == 0 and got[3, None] == 0
    assert count_tokens(none, RANKS_FILE).count() == 0
    assert inserts(none.select("source", "lang", F.col("id").alias("version"), F.col("n_chars").alias("tokens"))).count() == 0
