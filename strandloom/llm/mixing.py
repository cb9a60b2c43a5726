"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents. A document's virtual finish time is the number of words its
source has sent up to and including it, divided by the source's target. Ordered by finish time, every prefix of
the whole sequence holds the sources in proportion to their targets, and the mix is the prefix that fills the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import keep, table, word_count

#: Weights dealt to the sources in order of their names, again and again.
WEIGHTS = (5, 2, 1)
#: How often a document may be repeated.
MOST = 3
#: Words in one bucket of a queue, and of the whole sequence: the rows that one task orders.
BUCKET_WORDS = 500_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: ``source``, ``source_size``, ``weight``, ``target`` (words).

    All targets together are all words. A target above ``most`` times its source's size is cut to that, and what
    is cut off is shared out among the others by weight, until none is above: targets are ``min(cap, level * weight)``,
    and the level follows from running sums over the sources in order of cap / weight.
    Sources without words get target 0. The windows run over one row a source, not over documents.
    """
    every = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    every = every.withColumn("weight", F.element_at(kinds, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    every = every.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    every = every.withColumn("level", level)
    # The level of the first source that isn't capped holds for all after it.
    every = every.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return every.select("source", "source_size", "source_docs", "weight", target.alias("target"))


def running(df: DataFrame, group: list[str], order: list[str], size: str, bucket: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows of ``group`` up to this one in ``order``.

    ``bucket`` is a column that never falls in that order. Sums by bucket are gathered first, so a task orders
    one bucket, never a whole group.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in [*group, bucket]], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_own", F.sum(size).over(within))
    cond = own[bucket].eqNullSafe(sums[f"_{bucket}"])
    for c in group:
        cond = cond & own[c].eqNullSafe(sums[f"_{c}"])
    return own.join(sums, cond).withColumn(out, F.col("_before") + F.col("_own")).drop("_before", "_own", *[f"_{c}" for c in [*group, bucket]])


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 10, with_text: bool = False) -> DataFrame:
    """Every document with what the mix takes of it.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are ignored. Returns doc_id, size, source,
    source_size, target, taken (words, repeats counted), and the text if ``with_text``. A document is taken whole, up to ``most`` times.
    Null text: size 0, taken 0. Null source: a source of its own, last in order. Equal ids: each row is a document.
    No rows: no rows. The shuffle is a hash of ``seed`` and id, so reruns agree.
    """
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    sizes = docs.select("doc_id", "source", word_count().alias("size"), key.alias("_key"), F.monotonically_increasing_id().alias("_row"), *(["text"] if with_text else []))
    whole = keep(sizes, "mix-sizes")  # the row numbers are fixed from here on
    sizes = whole.drop("text")
    targets = keep(source_targets(sizes, weights, most), "mix-targets")
    # Sources are few against documents, but not provably so: Spark's own size check picks the join.
    named = targets.withColumnRenamed("source", "_source")
    queue = sizes.join(named, sizes["source"].eqNullSafe(named["_source"])).drop("_source", "weight")
    # The keys are uniform, so a queue's bucket by the key's leading digits holds about as many words as any other.
    buckets = F.greatest(F.lit(1), F.ceil(F.col("source_size") / BUCKET_WORDS))
    queue = queue.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2**32 * buckets).cast("long"))
    queue = running(queue, ["source"], ["_key", "doc_id"], "size", "_bucket", "_upto")
    sent = queue.filter((F.col("size") > 0) & (F.col("target") > 0)).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    sent = sent.withColumn("_sent", F.col("_round") * F.col("source_size") + F.col("_upto"))
    # Nothing that starts at or after its source's target can belong to the mix.
    sent = sent.filter(F.col("_sent") - F.col("size") < F.col("target"))
    sent = sent.withColumn("_finish", F.col("_sent") / F.col("target")).select("_row", "_key", "size", "_round", "_finish")
    # The global order: buckets of virtual time carry about as many words each.
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total")).first()["total"]
    step = max(1, -(-total // BUCKET_WORDS))
    sent = sent.withColumn("_slot", F.floor(F.col("_finish") * step).cast("long"))
    sent = running(sent.withColumn("_all", F.lit(0)), ["_all"], ["_finish", "_key", "_row"], "size", "_slot", "_total")
    taken = sent.filter(F.col("_total") <= total).groupBy("_row").agg(F.sum("size").alias("taken"))
    out = queue.join(taken, "_row", "left")
    out = out.select("_row", "doc_id", "size", "source", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).alias("taken"))
    return (out.join(whole.select("_row", "text"), "_row") if with_text else out).drop("_row")


def op10_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(table(spark, sf_dir, "documents")).drop("source")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what came through the stages before: doc_id, size, source_size, target, taken, text of every document.

    Those with taken = 0 aren't in the mix; the others are in it taken / size times. See ``fair_mix`` for nulls, ties,
    repeated rows and empty tables.
    """
    return fair_mix(docs, with_text=True).drop("source")
