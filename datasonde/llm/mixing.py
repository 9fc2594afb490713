"""Mix sources to target weights.

The words of each source are summed, targets are filled by weight up to a cap, and the
rate target / size says how often a source is repeated: every document is emitted
floor(rate) times, and once more by a hash-seeded draw with the probability of the fraction.

The draw compares a document's hash with a cut-off. A cut-off at the fraction itself would
leave a source with few or uneven documents far from its target by chance, so it is put
where the words of the documents below it come nearest to the fraction of the source's words.
That needs one sum for each source and hash value (65,536 of them), whatever the number of
documents; the texts themselves are read once more and never shuffled.

Missing texts and texts without words have size 0, and are emitted like all others. A missing
source is a source of its own. Repeated rows with one id share a draw. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datasonde.functions.shared import stored
from datasonde.llm.columns import free_name, packed, word_count



def draw(key: Column, seed: str) -> Column:
    """A hash value in 0 .. 65535 from the document's id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` with a column ``weight``: the weights in turn, by code point of the source, missing last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = (F.row_number().over(order) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int")))


def source_targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight) with ``target``: ``share`` of all words by weight, at most ``cap`` times each size.

    What a capped source can't take is shared again by weight until no source is above its cap.
    Ordered by cap / weight the capped sources come first, so running sums find them at once.
    """
    rows = sources.withColumn("limit_", F.col("source_size") * F.lit(cap))
    by_ratio = Window.orderBy(F.col("limit_") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("left_", F.col("wanted") - F.coalesce(F.sum("limit_").over(before), F.lit(0.0)))
        .withColumn("open_", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("limit_") * F.col("open_") <= F.col("left_") * F.col("weight"))
    )
    kept_back = F.sum(F.when(F.col("full"), F.col("limit_")).otherwise(0.0)).over(everything)
    full_weight = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)
    level = F.try_divide(F.col("wanted") - kept_back, F.col("weights") - full_weight)  # no weight is left if all are full
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("limit_")).otherwise(F.col("weight") * level))
    return rows.select("source", "source_size", "weight", "target")


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` as a struct ``row`` with size, source_size, target, copies and taken (words in all copies).

    Two passes: the first sums words by source and hash value (combined before the shuffle),
    the second applies one small row of rates per source.
    """
    sized = packed(docs, size=word_count(F.col(f"`{text}`")), source=F.col(f"`{source}`"), bin=draw(F.col(f"`{key}`"), seed))
    bins = stored(sized.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    sources = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(cyclic_weights(sources, weights), share, cap)
    rates = targets.withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    rates = rates.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))

    # A hash value is drawn if more than half of its words lie below the words still wanted.
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most 65,536 rows
    below = bins.withColumn("upto", F.sum("words").over(running))
    below = below.join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    drawn = below.filter(2 * F.col("upto") - F.col("words") < 2 * F.col("extra")).groupBy("of").agg(F.max("bin").alias("cut"))
    rates = rates.withColumnRenamed("source", "of").alias("r").join(drawn.alias("d"), F.col("r.of").eqNullSafe(F.col("d.of")), "left")
    # Stored, the rates have a known size, and are broadcast only if that is below Spark's threshold.
    rates = stored(rates.select("r.of", F.col("source_size").alias("of_size"), "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")).coalesce(1))
    planned = sized.join(rates, F.col("source").eqNullSafe(F.col("of")), "left")
    copies = (F.col("whole") + (F.col("bin") <= F.col("cut")).cast("long")).cast("long")
    return planned.select("row", "size", F.col("of_size").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as planned, with the number of the copy from 1."""
    plan = mixing_plan(docs, **options)
    repeated = plan.filter(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_"))
    names = docs.columns
    return repeated.select(*(F.col("row").getField(n).alias(n) for n in names), F.col("copy_").alias(free_name(docs, "copy")))
