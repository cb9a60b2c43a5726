"""References as tables: whole sequences (ref_id, seq), or parts (ref_id, from, part) that follow each other without gaps.

Parts are what a long reference is read as (``sources.reference``): no task ever holds all of one. What needs a
reference's bases gets them as blocks, cut from either form, and joins them by reference and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.shared import written


def blocks(seq: Column, size: int, over: int) -> Column:
    """The sequence cut into blocks of ``size`` bases, each followed by the ``over`` bases behind it.

    One pass: the pattern takes ``size`` bases and looks ahead for what follows.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{1,{size + over}}})).{{1,{size}}}"), F.lit(1))


def in_parts(refs: DataFrame) -> bool:
    return "part" in refs.columns


def lengths(refs: DataFrame) -> DataFrame:
    """ref_id, ref_length. A null sequence has a null length, and a reference without parts no row."""
    if not in_parts(refs):
        return refs.select("ref_id", F.length("seq").alias("ref_length"))
    return refs.groupBy("ref_id").agg(F.max(F.col("from") + F.length("part")).cast("int").alias("ref_length"))


def cut(refs: DataFrame, size: int, over: int) -> DataFrame:
    """ref_id, block (from 0), from, part: blocks of ``size`` bases, each with the ``over`` bases behind it.

    A part goes to all blocks that it meets, with what each needs of it, and a block is put together from what it
    gets: a shuffle by reference and block. Whole sequences are cut where they lie. Null and empty ones have no
    block; repeated whole sequences are cut each, and parts must not repeat.
    """
    if not in_parts(refs):
        rows = refs.select("ref_id", F.posexplode(blocks(F.col("seq"), size, over)).alias("block", "part"))
        return rows.select("ref_id", F.col("block").cast("long").alias("block"), (F.col("block").cast("long") * size).alias("from"), "part")
    start, end = F.col("from").cast("long"), F.col("from") + F.length("part")
    first = F.greatest(F.lit(0).cast("long"), F.floor((start - size - over) / size) + 1)
    rows = refs.filter(F.length("part") > 0).withColumn("block", F.explode(F.sequence(first, F.floor((end - 1) / size))))
    low, high = F.greatest(start, F.col("block") * size), F.least(end, F.col("block") * size + size + over)
    rows = rows.withColumns({"low": low, "high": high})
    piece = F.expr("substring(part, cast(low - from + 1 as int), cast(high - low as int))")
    whole = rows.groupBy("ref_id", "block").agg(F.sort_array(F.collect_list(F.struct("low", piece.alias("piece")))).alias("xs"))
    return whole.select("ref_id", "block", (F.col("block") * size).alias("from"), F.array_join(F.transform("xs", lambda x: x["piece"]), "").alias("part"))


def windows(rows: DataFrame, refs: DataFrame, start: str, length: str, by: list[str], least: int = 4096) -> DataFrame:
    """``rows`` (with ref_id) with window: the ``length`` bases of their reference from place ``start`` on, as far as it goes.

    An interval meets the block in which it starts: blocks are as long as the least power of two that holds the
    interval, and carry as many bases more, so intervals of each such size have blocks of their own (a few sizes). Only
    blocks that an interval starts in take part. Where very many start in one block, its rows are dealt out by ``by``.
    Rows without a reference, or that start behind its end, go.
    """
    size = F.greatest(F.lit(least), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col(length), F.lit(1)).cast("double")))).cast("int"))
    rows = rows.filter(F.col("ref_id").isNotNull()).withColumn("_size", size).withColumn("_block", F.floor(F.col(start) / F.col("_size")))
    keys = ["ref_id", "_size", "_block"]
    need = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_often"))
    kinds = [r["_size"] for r in need.select("_size").distinct().collect()]  # a row for each power of two
    found = None
    for kind in kinds:
        of = cut(refs, kind, kind).select("ref_id", F.lit(kind).alias("_size"), F.col("block").alias("_block"), F.col("part").alias("_part"))
        found = of if found is None else found.unionByName(of)
    if found is None:
        return rows.drop("_size", "_block").withColumn("window", F.lit(None).cast("string")).limit(0)
    out = spread_join(rows, written(found.join(need, keys), "blocks"), keys, "_often", by)
    at = (F.col(start) - F.col("_block") * F.col("_size") + 1).cast("int")
    return out.withColumn("window", F.substring("_part", at, F.col(length).cast("int"))).drop("_size", "_block", "_part")


#: A key's rows are dealt out in portions of this many at least.
PORTION = 64


def spread_join(left: DataFrame, right: DataFrame, on: list[str], often: str, by: list[str], parts: int | None = None) -> DataFrame:
    """The inner join of ``left`` with ``right``, whose keys are unique and never null, where a key may hold much of ``left``.

    ``often`` is a column of ``right``: how many rows of ``left`` have its key. A key with over a thousandth of all is
    dealt out: its row of ``right`` is repeated, and rows of ``left`` meet one of the copies, by their hash of ``by``.
    Such keys are fewer than a thousand, so what is broadcast is a small table of keys and numbers. ``often`` goes.
    With ``parts`` both sides are dealt into so many, which are not coalesced.
    """
    total = right.agg(F.coalesce(F.sum(often), F.lit(0)).alias("n")).first()["n"]
    portions = F.least(F.ceil(F.col(often) * 1000 / F.lit(max(total, 1))), F.ceil(F.col(often) / PORTION))
    hot = right.filter(F.col(often) * 1000 > F.lit(total)).select(*on, portions.alias("_n"))
    left = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_n", F.lit(1)))).drop("_n")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(portions, F.lit(1)) - 1))).drop(often)
    if parts is not None:
        left, right = left.repartition(parts, *on, "_salt"), right.repartition(parts, *on, "_salt")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def running_total(rows: DataFrame, order: list, size: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``size`` over the rows before, in ``order`` over the whole table.

    Rows are dealt by ranges and summed up within each; only the ranges' sums, a row a partition, are put in one place.
    """
    own = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": own})
    dealt = written(dealt, "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(size).alias("_n"))
    before = sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    upto = F.sum(size).over(Window.partitionBy("_range").orderBy("_at")) - F.col(size)
    return dealt.withColumn("_upto", upto).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_upto")).drop("_range", "_at", "_before", "_upto")
