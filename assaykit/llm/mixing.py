"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A source's target is a share of the total by weight, at most ``max_epochs`` times the source's size; what is above
that is shared among the others by weight again until none is above. Of its target a source first takes complete
epochs; for the rest each document draws an exponential key, divided by its quality weight, and the documents with
the smallest keys are taken whole until the budget is used up; the last one is taken if that comes nearer to it.

No source is sorted in one task. Keys are cut into bins of equal width in their logarithm; the sizes of a source's
bins, summed in order, show the one bin that the budget ends in, and only that bin's rows are looked at closer. Whatever
the weights, an exponential key falls into a bin of width d with a probability of at most d / e, so the width that
follows from a source's number of documents leaves about ``bin_rows`` different keys in such a bin at most. Rows that
tie in all that is returned are counted first; the running sum goes over the counted groups, and how many of the one
group that the budget ends in are taken is a division, so any number of copies is one row of that sort. Sources are
ranked and summed up by ranges, none of them in a single task.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, sorted last; a
document's key depends on its id, or on its text if it has none; rows that repeat an id have one key and are taken one
after the other, so are texts that repeat without ids; a very long text is one row; an empty table gives an empty
result; a total of 0 gives targets of 0. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import cut, small_side, word_count

#: Rows that one row is turned into at most.
PIECE = 10_000


def running_sums(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name, the sum over the rows before in that order: within ranges, and over the ranges before."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(f"all_{k}") for k, c in sums.items()])  # a row for each task
    offsets = totals.select("range", *[F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"all_{k}") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(offsets), "range")
    return found.withColumns({k: F.col(k) + F.col(f"all_{k}") for k in sums}).drop("range", *[f"all_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size), one for each source.

    Sources sorted by ratio of cap to weight are at their cap up to some point; the level of the others follows
    from what is left. That point is found with running sums over the sources, not over documents.
    """
    ranked = running_sums(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).drop("rank").withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    summed = running_sums(rows, [F.col("ratio"), F.col("source").asc_nulls_last()], {"capped_before": F.col("cap"), "weight_before": F.col("weight")})
    budget, all_weight = rows.agg((F.sum("source_size") * F.lit(share)), F.sum("weight")).first()
    summed = cut(summed.withColumn("level", (F.lit(budget) - F.col("capped_before")) / (F.lit(all_weight) - F.col("weight_before"))))
    # The first source, in that order, whose cap is not below its share sets the level; those before are at their cap.
    # Of sources that tie in their ratio the first has the highest level.
    first = summed.where(F.col("cap") >= F.col("level") * F.col("weight")).agg(F.min(F.struct(F.col("ratio"), -F.col("level"), F.col("level").alias("level"))).alias("first")).select("first.level").first()[0]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("weight"))
    return summed.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A uniform draw above 0 and at most 1 that depends on the seed and the id alone, or on the text's hash if that is null."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")))), 1, 12), 16, 10).cast("double")
    return (bits + 1) / F.lit(float(1 << 48))


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: the fourth power of the share of characters that aren't mark-up or currency symbols."""
    clean = F.try_divide(F.length(F.translate(text, "#*$%&|<>", "")), F.length(text))
    return F.coalesce(F.greatest(F.lit(0.05), clean * clean * clean * clean), F.lit(0.05))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 42,
    bin_rows: int = 32_768,
    broadcast_rows: int = 100_000,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken, epochs): epochs is how often the mix takes the document.

    What is known of each source is broadcast up to broadcast_rows sources; beyond, the joins shuffle.
    """
    exponential = -F.log(draw(F.col(doc_id), F.col(text), seed)) / quality_weight(F.col(text))
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), exponential.alias("key")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per_unit = F.greatest(F.lit(1.0), F.col("n") / (bin_rows * math.e))
    totals = cut(totals)
    plans = totals.join(source_targets(totals.select("source", "source_size"), weights, share, max_epochs).withColumnRenamed("source", "s").withColumnRenamed("source_size", "z"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "z")
    full = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    plans = cut(plans.withColumn("full", full.cast("long")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("per_unit", per_unit).withColumnRenamed("source", "s"))
    plans = small_side(plans, broadcast_rows)
    planned = sized.join(plans, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    binned = planned.withColumn("bin", F.floor(F.log(F.greatest("key", F.lit(1e-300))) * F.col("per_unit")))
    # The bin of each source where the budget ends, and the words in the bins before it.
    running = Window.partitionBy("source").orderBy("bin")
    sums = binned.groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    upto = sums.withColumn("upto", F.sum("words").over(running))
    ends = upto.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    ends = cut(ends.select(F.col("source").alias("s"), F.col("end.bin").alias("end_bin"), F.col("end.before").alias("before")))
    marked = binned.join(small_side(ends, broadcast_rows), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # In that bin: groups of rows that tie in all that is returned, and how many of each are within the budget.
    place = F.struct(F.col("key"), F.col("doc_id"), F.col("size"), F.col("text_hash"))
    same = ["source", "key", "doc_id", "size", "text_hash", "source_size", "target", "full", "rest", "before"]
    groups = marked.where(F.col("bin") == F.col("end_bin")).groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    in_bin = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(in_bin), F.lit(0))
    # A copy is taken if its middle is within the budget; only the last group that begins within it can be divided.
    fit = F.when(F.col("size") == 0, F.col("copies")).otherwise(F.floor((F.col("rest") - start - F.col("size") / 2) / F.col("size")) + 1)
    fits = F.least(F.col("copies"), F.greatest(F.lit(0), F.when(start + F.col("size") / 2 <= F.col("rest"), F.greatest(F.lit(1), fit)).otherwise(F.lit(0)))).cast("long")
    counted = groups.withColumn("fits", fits)
    last = cut(counted.where("fits > 0").groupBy("source").agg(F.max_by(F.struct("key", "doc_id", "size", "text_hash", "copies", "fits", "source_size", "target", "full", "rest"), place).alias("last")))
    divided = last.where("last.fits < last.copies")
    marked = marked.join(small_side(last.select(F.col("source").alias("s"), "last"), broadcast_rows), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    limit = F.struct(*[F.col(f"last.{c}").alias(c) for c in ("key", "doc_id", "size", "text_hash")])
    ended = F.col("bin") == F.col("end_bin")
    within = F.when(F.col("end_bin").isNull(), True).when(~ended, F.col("bin") < F.col("end_bin")).otherwise(F.coalesce(place <= limit, F.lit(False)))
    whole = marked.where(~F.coalesce(ended & (place == limit) & (F.col("last.fits") < F.col("last.copies")), F.lit(False))).withColumn("extra", within.cast("long"))
    # The divided group's rows are alike, so they are written anew: as many as there were, PIECE of them a row first.
    numbers = divided.select("source", "last.*").withColumn("piece", F.explode(F.expr(f"sequence(0, (copies - 1) div {PIECE})")))
    again = numbers.repartition("piece").withColumn("nth", F.explode(F.expr(f"sequence(piece * {PIECE}, least(copies, (piece + 1) * {PIECE}) - 1)"))).withColumn("extra", (F.col("nth") < F.col("fits")).cast("long"))
    kept = ["doc_id", "text_hash", "source", "size", "source_size", "target", "full", "rest", "extra"]
    out = whole.select(kept).unionByName(again.select(kept)).withColumn("epochs", F.when(F.col("size") > 0, F.col("full") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(F.lit(0))).otherwise(F.lit(0)))
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), F.col("epochs").cast("long").alias("epochs"))
