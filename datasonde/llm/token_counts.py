"""Token totals by source, language and tokenizer version, maintained by signed changes.

Documents are counted once, when they come. Every later change is a signed row: an insert
adds its tokens and one document, a delete takes them away, a revised count adds what it
differs by. A batch of changes is folded to one row for each (source, lang, version), combined
before the shuffle, so a source with a third of the rows is one row per task; totals are the
sums of the folded batches, and never read a document again.

A batch is committed in two steps: its sums are written to a folder of their own, then one row
in the table of commits, in a folder of its own as well, names them. A batch that is repeated,
after a lost driver or by a second sender, is found among the commits and changes nothing; sums
without a commit are never read; of two commits of one batch, the one of the lesser folder counts.

``compact`` writes a snapshot: the sums of all batches so far and, as a table, their names. Totals
are those of one snapshot and of the batches that it doesn't name, so any number of compactions at
once, over the same or over different batches, can't count a batch twice. The driver sees the
folders since that snapshot; the names of older batches stay in tables.

Changes may lack a source or a language: those form groups of their own. A missing count is 0.
Repeated rows in one batch count again, as documents do. Groups that come to no documents and
no tokens stay in the totals with zeros. An empty batch is committed like any other.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("source", "lang", "version")
# A row with a table of names is a snapshot, of all batches in that table.
COMMIT = "batch string, folder string, names string, generation int"
SUMS = "source string, lang string, version string, n_docs long, n_tokens long"
# Pieces in which a text is encoded: the published pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def tokenizer(ranks_file: str):
    """A byte-pair tokenizer from a public file of (base64 token, rank) lines."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name=ranks_file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, ranks_file: str, name: str = "tokens") -> DataFrame:
    """``docs``, whose text column is ``text``, with the number of tokens instead of the text.

    ``ranks_file`` is installed with the tokenizers on every machine; it isn't part of the input.
    """
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks_file).encode_ordinary
        for batch in batches:
            counts = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(counts, pa.int64())], [*others, name])

    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(name, T.LongType())])
    return docs.select(*others, "text").mapInArrow(run, schema)


def inserts(rows: DataFrame) -> DataFrame:
    """Signed changes of new (source, lang, version, tokens) rows."""
    return _signed(rows, F.lit(1), F.coalesce("tokens", F.lit(0)))


def deletes(rows: DataFrame) -> DataFrame:
    """Signed changes of rows that go, with the tokens they were counted with."""
    return _signed(rows, F.lit(-1), -F.coalesce("tokens", F.lit(0)))


def revisions(rows: DataFrame) -> DataFrame:
    """Signed changes of rows counted anew: ``tokens`` is the new count, ``old_tokens`` the old one."""
    return _signed(rows, F.lit(0), F.coalesce("tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0)))


def _signed(rows: DataFrame, docs, tokens) -> DataFrame:
    return rows.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


class TokenLedger:
    """Committed batches of signed changes in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        try:
            self._rows()
        except AnalysisException:  # no commits yet: an empty row set makes their table readable
            self._commits(spark.createDataFrame([], COMMIT))

    def _new(self, kind: str) -> str:
        return f"{self.folder}/{kind}/by=x{uuid.uuid4().hex}"

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits").select("batch", "folder", "names", "generation")

    def _commits(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.parquet(self._new("commits"))

    def _names(self, snapshot: Row | None) -> DataFrame:
        if snapshot is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(snapshot["names"])

    def _state(self) -> tuple[Row | None, dict[str, str]]:
        """The latest snapshot, and batch -> folder of the sums for each batch it doesn't name."""
        rows = self._rows()
        snapshot = rows.filter("names is not null").orderBy(F.desc("generation"), "folder").first()
        single = rows.filter("names is null").groupBy("batch").agg(F.min("folder").alias("folder"))
        later = single.join(self._names(snapshot), "batch", "left_anti").collect()  # commits since the snapshot
        return snapshot, {r["batch"]: r["folder"] for r in later}

    def committed(self) -> dict[str, str]:
        """Batch -> folder of its sums: the latest snapshot and each batch since."""
        snapshot, later = self._state()
        return later if snapshot is None else {snapshot["batch"]: snapshot["folder"], **later}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed changes under the name ``batch``; False, and no change, if it was committed before."""
        if not self._rows().filter(F.col("batch") == batch).isEmpty():
            return False
        folder = self._new("sums")
        _added(changes).write.parquet(folder)
        self._commits(self.spark.createDataFrame([(batch, folder, None, None)], COMMIT))
        return True

    def _sums(self, folders: list[str]) -> DataFrame:
        read = self.spark.read.schema(SUMS)
        rows = read.parquet(*folders).select(*KEYS, "n_docs", "n_tokens") if folders else self.spark.createDataFrame([], SUMS)
        return _added(rows)

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        return self._sums(list(self.committed().values()))

    def compact(self) -> str:
        """Write a snapshot of all committed batches; its name. Their names stay known."""
        snapshot, later = self._state()
        folders = [*later.values(), *([] if snapshot is None else [snapshot["folder"]])]
        folder, names = self._new("sums"), self._new("names")
        self._sums(folders).write.parquet(folder)
        added = self.spark.createDataFrame([(b,) for b in later], "batch string")
        self._names(snapshot).unionByName(added).write.parquet(names)
        name = f"snapshot-{uuid.uuid4().hex}"
        generation = 1 if snapshot is None else snapshot["generation"] + 1
        self._commits(self.spark.createDataFrame([(name, folder, names, generation)], COMMIT))
        return name


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
