"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its share of all words is
the schedule's integral, the excess over max_epochs times its size going to the other
sources. Words are demanded over time as the schedule's running integral; a document's
place in its source's queue is a number of words, and the inverse of the cumulative
demand at that number is its position in training. Queues run in the order of an MD5 of
the row, epoch after epoch; the last epoch ends where the target is met, so one document
of each source may be taken in part.

Queues are cut into buckets by that hash, so that no task holds a whole source: bucket
totals are summed before the shuffle, and a running sum within a bucket starts from
them.

Nulls: a null text has size 0 and is taken 0 times; a null source is one of its own, after the
others. Repeated rows are documents each by itself, one after the other. An
empty table gives an empty result. A null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stash, unused

#: Weights of the sources in code-point order, repeating; and how often a document may be taken.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
#: A source's weight at the start and the end of training, relative to its mean: straight in between. By place in WEIGHTS.
SLOPES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
#: Buckets of a source's queue: a power of two, so that a bucket is a range of the hash.
BUCKET_BITS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, source, size, key (of doc_id, source and text), whose order is the queue's, and its first bits: the bucket."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), row_key(doc_id, text, source).alias("key"), n_words(F.col(text)).alias("size"))
    return rows.withColumn("bucket", F.shiftright(F.conv(F.substring(F.hex("key"), 1, 4), 16, 10).cast("int"), 16 - BUCKET_BITS))


def targets(by_source: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, slot from source, source_size (one row a source).

    Shares by weight with what is over max_epochs times a size given to the rest by
    weight, again and again, end at min(cap, level x weight) with one level for all.
    Sources that reach their cap first stand first in the order of cap / weight.
    """
    slot = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    w = F.array(*[F.lit(float(x)) for x in weights])
    rows = by_source.select("source", "source_size", slot.cast("int").alias("slot"))
    rows = rows.withColumn("w", F.get(w, "slot")).withColumn("cap", max_epochs * F.col("source_size"))
    rank = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    upto, everything = rank.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    total = F.sum("source_size").over(everything)
    rest_words = total - F.sum("cap").over(upto) + F.col("cap")
    rest_weight = F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")
    level = rest_words / rest_weight
    # the level is that of the first source that stays below its cap
    rows = rows.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("w"))
    found = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    rows = rows.withColumn("found", found)
    target = F.when(F.col("found").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("found") * F.col("w")))
    return rows.select("source", "source_size", target.alias("target"), "slot")


def position(words: Column, target: Column, slot: Column, slopes: tuple = SLOPES) -> Column:
    """The time at which a source has demanded so many words: the inverse of the integral of its straight-line schedule.

    With weight a + (b - a) t of mean 1, the demand by t is target (a t + (b - a) t^2 / 2).
    """
    a = F.get(F.array(*[F.lit(float(x)) for x, _ in slopes]), slot)
    b = F.get(F.array(*[F.lit(float(y)) for _, y in slopes]), slot)
    mean, d = (a + b) / 2, b - a
    share = F.least(words / F.nullif(target, F.lit(0.0)), F.lit(1.0)) * mean
    return F.when(d == 0, share / a).otherwise((F.sqrt(a * a + 2 * d * share) - a) / F.nullif(d, F.lit(0.0)) + 0.0)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """key, doc_id, size, source, source_size, target, taken, n_copies, positions, position: a row for each row of docs, in training order.

    taken: words that the mix takes of it, repeats counted; positions: when, one for
    each time it is begun; position: the first; null if it is never taken.
    """
    rows = stash(sizes(docs, doc_id, text, source), "mixing-sizes")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    queue = Window.partitionBy("source").orderBy("bucket")
    before = buckets.select("source", "bucket", (F.sum("bucket_size").over(queue) - F.col("bucket_size")).alias("before"))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs=max_epochs)
    plan = before.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", "slot")
    within = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.sum("size").over(within) - F.col("size"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("at") + F.col("before"))
    quota = F.round("target").cast("bigint")
    epochs = F.array(*[F.lit(e).cast("bigint") for e in range(max_epochs)])
    begun = F.transform(epochs, lambda e: e * F.col("source_size") + F.col("at"))
    taken = F.aggregate(begun, F.lit(0).cast("bigint"), lambda n, x: n + F.least(F.greatest(quota - x, F.lit(0).cast("bigint")), F.col("size")))
    times = F.transform(F.filter(begun, lambda x: (x < quota) & (F.col("size") > 0)), lambda x: position(x, F.col("target"), F.col("slot")))
    out = rows.select("key", "doc_id", "size", "source", "source_size", "target", taken.alias("taken"), F.size(times).cast("bigint").alias("n_copies"), times.alias("positions"))
    out = out.withColumn("position", F.get("positions", F.lit(0)))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs as the mix takes them, in training order: a row for each time a document is begun, none where it is not taken.

    The document at which a source meets its target is cut after the last word taken.
    """
    plan = mix(docs, doc_id, text, source, max_epochs).where("n_copies > 0")
    key, nth, at, n, size = unused(docs, "row_key", "nth", "position", "n_words", "size")
    # equal rows share a key; each gets its own line of the plan by its number among them
    plan = plan.select(F.col("key").alias(key), F.col("size").alias(size), "taken", "positions").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy("positions")))
    plan = plan.select(key, nth, size, "taken", F.posexplode("positions").alias("epoch", at))
    plan = plan.select(key, nth, at, F.least(F.col("taken") - F.col("epoch") * F.col(size), F.col(size)).cast("int").alias(n), size)
    rows = docs.withColumn(key, row_key(doc_id, text, source)).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).join(plan, [key, nth])
    words = F.regexp_extract_all(F.col(text), F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    cut = F.when(F.col(n) < F.col(size), F.array_join(F.slice(words, F.lit(1), F.col(n)), "")).otherwise(F.col(text))
    rows = rows.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], at)
    return rows.repartitionByRange(at).sortWithinPartitions(at).drop(at)
