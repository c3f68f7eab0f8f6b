"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated up to `epochs` times. A queued document's virtual
finish time is the words its source has handed out, itself included, divided by the source's target. All queues are
merged by one global range sort on that time and cut at the total budget, so every source is served in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickweir.llm.rows import content_key, repeated
from clickweir.llm.running import running_total
from clickweir.session import scratch

WORD = r"[^\x20\x09-\x0D]+"


def stored(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def source_targets(spark: SparkSession, sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(source, source_size, target) for `sized` (source, size).

    Sources in code-point order, null last, get `weights` in turn and share the total of all sizes; a target stops at
    `epochs` times its source's size and the excess is shared again by weight until none is above. With sources in
    ascending order of the share at which each is full (cap / weight), a source is full if the budget left by the full
    ones before it, per weight left, reaches its own share. Ranks and sums are global range sorts, as sources may be many.
    """
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = running_total(spark, sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], F.lit(1), "_rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    weighted = (ranked.withColumn("_weight", turn).withColumn("_cap", (F.col("source_size") * epochs).cast("double"))
                .withColumn("_full", F.col("_cap") / F.col("_weight")))
    by_weight = running_total(spark, weighted, ["_full", "_rank"], F.col("_weight"), "_weights")
    capped = stored(spark, running_total(spark, by_weight, ["_full", "_rank"], F.col("_cap"), "_caps"), "sources")
    budget, weights_of_all = (capped.agg(F.sum(c)).scalar() for c in ("source_size", "_weight"))
    # The level per weight when exactly this source and those before it are full; it is full if its own share is below.
    level = (budget - (F.col("_caps") - F.col("_cap"))) / (weights_of_all - (F.col("_weights") - F.col("_weight")))
    judged = capped.withColumn("_is_full", F.col("_full") <= level)
    used = judged.agg(F.sum(F.when(F.col("_is_full"), F.col("_cap")).otherwise(0.0))).scalar()
    left = judged.agg(F.sum(F.when(F.col("_is_full"), 0.0).otherwise(F.col("_weight")))).scalar()
    share = (budget - used) * F.col("_weight") / left
    return judged.select("source", "_rank", "source_size", F.when(F.col("_is_full"), F.col("_cap")).otherwise(share).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, seed: str = "mix",
        row: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, row) for every row of `docs` (doc_id, text, source).

    `row` is a column that tells rows apart, a running number if none is given; rows that share it share their copies.
    Size is the number of words of the text, 0 for null. The shuffle orders a source by the MD5 of `seed` and doc_id
    (rows of one id by size), so reruns agree; each epoch repeats it. A copy is taken if the words up to and including
    it, over all sources, stay within the budget, the total of all sizes. Documents of size 0 are never taken: copies 0.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stored(spark, docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("_key"), (F.monotonically_increasing_id() if row is None else row).alias("_row")), "sizes")
    targets = stored(spark, source_targets(spark, sized, weights, epochs), "targets")
    queued = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    # One running sum over all queues, one after the other; a queue's own sum starts where the queues before it end.
    summed = running_total(spark, queued, ["_rank", "_key", "doc_id", "size", "_row"], F.col("size"), "_sum")
    before = running_total(spark, targets, ["_rank"], F.col("source_size"), "_end")
    starts = before.select("_rank", (F.col("_end") - F.col("source_size")).alias("_start"))
    queue = (summed.where("size > 0").join(starts, "_rank")
             .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
             .withColumn("_time", (F.col("_epoch") * F.col("source_size") + F.col("_sum") - F.col("_start")) / F.col("target"))
             .select("_time", "_rank", "_epoch", "_key", "doc_id", "size", "_row"))
    served = running_total(spark, queue, ["_time", "_rank", "_epoch", "_key", "doc_id", "size", "_row"], F.col("size"), "_served")
    budget = targets.agg(F.sum("source_size")).scalar()
    copies = served.where(F.col("_served") <= budget).groupBy("_row").agg(F.count("*").alias("copies"))
    return (queued.join(copies, "_row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("_row").alias("row")))


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """The rows of `docs` that mix() takes, each as often as it is taken."""
    taken = mix(spark, docs, weights, epochs, row=content_key(docs))
    return repeated(docs, taken.groupBy(F.col("row").alias("_key")).agg(F.max("copies").alias("_copies"), F.count("*").alias("_rows")))
