"""The query of the conversation repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasonde.llm import conversation_repair as repairing
from datasonde.llm.registry import query, table

NO_ROWS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@query("op13_conversation_repair")
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    found = repairing.repair(repairing.damaged(rows))
    names = rows.select("conv").distinct()
    marks = repairing.digests(found.rows)
    whole = names.alias("n").join(found.conversations.alias("c"), F.expr("n.conv <=> c.conv"), "left")
    whole = whole.join(marks.alias("m"), F.expr("n.conv <=> m.conv"), "left")
    return whole.selectExpr(
        "n.conv as conv_id",
        *(f"coalesce({c}, 0L) as {c}" for c in COUNTS),
        "coalesce(audit, '') as audit",
        f"coalesce(sha256, '{NO_ROWS}') as repaired_sha256",
    )
