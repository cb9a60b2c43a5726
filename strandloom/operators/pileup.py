"""Depth, pileup and majority calls, and what is written of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandloom.operators.references import cut
from strandloom.sources.shared import written

#: Bases of a reference that meet calls in one row.
PIECE = 4096


#: Places of a reference that one running sum covers.
REGION = 1 << 16


def depth(intervals: DataFrame, keys: list[str], at: DataFrame | None = None) -> DataFrame:
    """keys, position, depth: where the number of intervals [start, end) that hold a position changes, and to what;
    with ``at`` (keys, position) also at those positions.

    Ends and starts are added up per position first, and running sums go over regions, with the sums of the regions
    before added: a task orders the changes in one region, not in a whole reference. An empty interval changes
    nothing, but its place is listed. Rows with a null key or end are left out; repeated intervals count each.
    """
    ends = intervals.dropna(subset=[*keys, "start", "end"]).select(*keys, F.explode(F.array(F.struct(F.col("start").alias("position"), F.lit(1).alias("n")), F.struct(F.col("end").alias("position"), F.lit(-1).alias("n")))).alias("e")).select(*keys, "e.*")
    if at is not None:
        ends = ends.unionByName(at.select(*keys, "position", F.lit(0).alias("n")))
    change = ends.groupBy(*keys, "position").agg(F.sum("n").alias("n")).withColumn("region", F.floor(F.col("position") / REGION))
    before = Window.partitionBy(*keys).orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    carried = change.groupBy(*keys, "region").agg(F.sum("n").alias("sum")).select(*keys, "region", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("carried"))
    upto = Window.partitionBy(*keys, "region").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    own = change.withColumn("own", F.sum("n").over(upto)).join(carried, [*keys, "region"])
    return own.select(*keys, "position", (F.col("own") + F.col("carried")).alias("depth"))


def active(mapped: DataFrame, length_adjust, ref_length) -> DataFrame:
    """Adds start and end: where a mapped read counts. A read before the reference never does; one whose end isn't
    behind its start does up to the reference's end. A null mapping has no row, and a null sequence a null end."""
    start = F.col("mapping")["position"]
    end = start + length_adjust + F.length("seq")
    return mapped.filter(start >= 0).withColumn("start", start).withColumn("end", F.when(end <= start, ref_length).otherwise(end))


def read_mutations(mapped: DataFrame, seen: Observation | None = None) -> DataFrame:
    """ref_id, read_idx, position, type, new_base, turn, start: at most one indel (the first) and one mismatch of a read
    at a position.

    ``mapped`` has ref_id, read_idx (unique), seq, mapping, start, end, ref_length. An insertion of n bases before P
    stands at P - 1 to P + n - 2. A null mapping has none. ``seen`` observes how many indel bases are dropped beside another.
    """
    own = ["ref_id", "read_idx", "start", "end", "ref_length"]
    indel = mapped.select(*own, "seq", F.posexplode(F.col("mapping")["indels"]).alias("at", "x"), F.col("mapping")["indels"].alias("all"))
    shift = F.aggregate(F.slice("all", 1, F.col("at") + 1), F.lit(0), lambda a, x: a + F.when(x["type"] == "D", x["length"]).otherwise(0))
    first = F.when(F.col("x.type") == "I", F.col("x.position") - 1).otherwise(F.col("x.position"))
    each = indel.filter("x.length > 0").withColumn("shift", F.when(F.col("x.type") == "I", shift).otherwise(0)).withColumn("position", F.explode(F.sequence(first, first + F.col("x.length") - 1)))
    best = Window.partitionBy("read_idx", "position").orderBy("at")
    each = each.withColumn("rank", F.row_number().over(best))
    if seen is not None:
        each = each.observe(seen, F.coalesce(F.sum((F.col("rank") > 1).cast("long")), F.lit(0).cast("long")).alias("dropped"))
    each = each.filter("rank = 1")
    base_at = F.col("position") - F.col("start") + F.col("shift") + 1
    base = F.when(F.col("x.type") == "I", F.expr("substring(seq, position - start + shift + 2, 1)"))
    each = each.filter((F.col("x.type") == "D") | ((base_at >= 0) & (base_at < F.length("seq"))))
    indels = each.select(*own, "position", F.col("x.type").alias("type"), base.alias("new_base"), F.lit(0).alias("turn"))
    other = mapped.select(*own, F.explode(F.col("mapping")["mismatches"]).alias("x"))
    other = other.select(*own, F.col("x.position").alias("position"), F.lit("S").alias("type"), F.col("x.new_base").alias("new_base"), F.lit(1).alias("turn"))
    return indels.unionByName(other).filter("position >= start and position < end and position < ref_length and position >= 0").drop("end", "ref_length")


def majority(votes: DataFrame, keys: list[str], choice: list[str], order: list[str], totals: DataFrame) -> DataFrame:
    """keys, choice, n: the most frequent choice under each key (ties: the one seen first in ``order``), if it has
    more than half of ``total`` in ``totals``. A null choice is one like others; null keys have no total and no row."""
    count = votes.groupBy(*keys, *choice).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    top = count.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", *choice)).alias("top"))
    return top.select(*keys, *[F.col(f"top.{c}").alias(c) for c in choice], (-F.col("top.m")).alias("n")).join(totals, keys).filter("n > total div 2").select(*keys, *choice, "n")


def mutation_lines(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """ref_id, position, line: '>S<position> <base> <new base>', '>I<position> <new base>' or '>D<position> <base>'.

    References are cut into pieces that meet the calls by reference and place. A call behind its reference's end or of
    another reference has no line, one with a null type or position neither; repeated calls repeat their lines.
    """
    pieces = cut(refs, PIECE, 0).select("ref_id", F.col("block").alias("piece"), "part")
    rows = calls.withColumn("piece", F.expr(f"position div {PIECE}")).join(pieces, ["ref_id", "piece"])
    base = F.expr(f"substring(part, position % {PIECE} + 1, 1)")
    line = F.when(F.col("type") == "S", F.concat(base, F.lit(" "), "new_base")).when(F.col("type") == "I", F.col("new_base")).otherwise(base)
    return rows.select("ref_id", "position", F.concat(F.lit(">"), "type", F.col("position").cast("string"), F.lit(" "), line).alias("line"))


def ranked(rows: DataFrame, first: str, second: str) -> DataFrame:
    """``rows`` with rank: the place, from 0, by ``first`` (nulls last), then ``second``.

    Rows are dealt by ranges and numbered within each; only the ranges' sizes are summed up in one place. Rows equal in
    both stand in any order next to each other. No rows: no rows.
    """
    order = [F.col(first).asc_nulls_last(), F.col(second).asc()]
    dealt = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "rank-ranges")
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "range").withColumn("rank", (place + F.col("before")).cast("long")).drop("range", "before")


def mapping_order(mapped: DataFrame) -> DataFrame:
    """rank, label, position: all reads by mapped position, of equal ones by read_idx (unique), unmapped ones last."""
    return ranked(mapped.select("label", "position", "read_idx"), "position", "read_idx").select("rank", "label", "position")
