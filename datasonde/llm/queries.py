"""All corpus queries; importing the modules registers them."""

from __future__ import annotations

import corpus_pipeline
from datasonde.llm import queries_audit, queries_conversations, queries_models, queries_native, queries_pairs, queries_tokens  # noqa: F401
from datasonde.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
