"""Exact occurrences of patterns, by an equi-join on sampled short strings, and suffix order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.references import cut, in_parts, lengths, running_total, spread_join
from strandloom.sources.shared import written

#: Bases of one block of a reference, at least; blocks are cut in one pass over the sequence. A substring is found by
#: counting from the front, so blocks are short.
BLOCK = 256


def classes_of(patterns: DataFrame, k: int) -> list[tuple[int, int, int, int]]:
    """(class, k, stride, greatest length) of the patterns by length: each class goes up to twice its least length.

    A class is searched by strings of at most ``k`` bases; where its patterns are longer than that, only every
    stride-th place of a reference has to be looked up. At most one row for each power of two comes to the driver.
    """
    own = F.floor(F.log2(F.length("pattern"))).cast("int")
    rows = patterns.filter(F.length("pattern") > 0).groupBy(own.alias("class")).agg(F.min(F.length("pattern")).alias("low"), F.max(F.length("pattern")).alias("high")).collect()
    return [(r["class"], min(k, r["low"]), r["low"] - min(k, r["low"]) + 1, r["high"]) for r in sorted(rows)]


def exact_find(refs: DataFrame, patterns: DataFrame, k: int = 16, by_ref: bool = False) -> DataFrame:
    """ref_id, pattern_id, pos: all starts, overlapping ones too, of patterns (pattern_id, pattern) in references
    (ref_id, seq). With ``by_ref``, patterns carry ref_id and meet it only.

    Substring search can't be a join key. Starts are therefore dealt into segments of a stride, and one string of
    ``k`` bases at each segment's last start stands for it; a pattern that begins anywhere in the segment holds that
    string at one of its first places. These strings' hashes are joined, and the pattern is compared with the
    segment's surroundings, which go with it. Null and empty patterns have no occurrences, and null and empty
    references hold none; null ids are ids like others. Each row of either side counts for itself, so repeated rows
    repeat their hits. No rows: no rows.
    """
    kinds = classes_of(patterns, k)
    if not kinds:
        return refs.join(patterns.select("pattern_id").limit(0), F.lit(True)).select("ref_id", "pattern_id", F.lit(0).alias("pos")).limit(0)
    over = max(stride + high for _, _, stride, high in kinds)
    block = max(BLOCK, over // 2)
    rows = cut(refs, block, over)

    def segments(kind: int, width: int, stride: int, high: int) -> Column:
        first = F.ceil(F.col("from") / stride) * stride
        last = F.least(F.col("from") + block - 1, F.col("from") + F.length("part") - (stride + width - 1))
        at = lambda w: w - F.col("from") + 1
        one = lambda w: F.struct(F.lit(kind).alias("class"), F.xxhash64(F.substring("part", (at(w) + stride - 1).cast("int"), F.lit(width))).alias("key"), w.alias("start"), F.substring("part", at(w).cast("int"), F.lit(stride - 1 + high)).alias("near"))
        return F.when(first <= last, F.transform(F.sequence(first, last, F.lit(stride)), one)).otherwise(F.array())

    index = rows.select("ref_id", F.explode(F.concat(*[segments(*x) for x in kinds])).alias("x")).select("ref_id", "x.*")
    want = patterns.filter(F.length("pattern") > 0).withColumn("class", F.floor(F.log2(F.length("pattern"))).cast("int"))

    def strings_of(width: int, stride: int) -> Column:
        one = lambda o: F.struct(F.xxhash64(F.substring("pattern", o + 1, F.lit(width))).alias("key"), (F.lit(stride - 1) - o).alias("shift"))
        return F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), one)

    strings = F.lit(None)
    for kind, width, stride, _ in kinds:
        strings = F.when(F.col("class") == kind, strings_of(width, stride)).otherwise(strings)
    want = want.withColumn("s", F.explode(strings)).select(*(["ref_id"] if by_ref else []), "pattern_id", "pattern", "class", F.col("s.key"), F.col("s.shift"))
    if by_ref:
        want = want.withColumnRenamed("ref_id", "_ref")
        got = index.join(want.withColumnsRenamed({"class": "_class", "key": "_key"}), F.col("ref_id").eqNullSafe(F.col("_ref")) & (F.col("key") == F.col("_key")) & (F.col("class") == F.col("_class")))
    else:
        got = index.join(want, ["class", "key"])
    return got.filter(F.expr("substring(near, shift + 1, length(pattern)) = pattern")).select("ref_id", "pattern_id", (F.col("start") + F.col("shift")).cast("int").alias("pos"))


def seed_hits(tiles: DataFrame, refs: DataFrame, k: int = 16, by_ref: bool = False) -> DataFrame:
    """ref_id, pattern_id, hits: the sorted starts of each tile (pattern_id, pattern) in each reference; none: no row.

    Rows of ``tiles`` with one pattern_id are taken together.
    """
    return exact_find(refs, tiles, k, by_ref).groupBy("ref_id", "pattern_id").agg(F.sort_array(F.collect_list("pos")).alias("hits"))


def occurrences(pattern: str, text: str) -> list[int]:
    """The sorted starts of a pattern in a text that a task holds, overlapping ones too."""
    out, at = [], text.find(pattern)
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


#: Letters of a suffix that the first ranks go by.
HEAD = 16
#: Suffixes of sequences of so many letters or fewer are ordered in their row.
SHORT = 256


def short_order(refs: DataFrame) -> DataFrame:
    """``suffix_order`` of sequences of up to ``SHORT`` letters: an array of suffixes is sorted in each row, without a shuffle."""
    own = F.transform(F.sequence(F.lit(0), F.length("seq")), lambda i: F.struct(F.substring("seq", i + 1, F.length("seq")).alias("suffix"), i.alias("start")))
    starts = F.transform(F.sort_array(own), lambda x: x["start"])
    return refs.select("ref_id", F.posexplode(starts).alias("rank", "start")).select("ref_id", F.col("rank").cast("long").alias("rank"), F.col("start").cast("int").alias("start"))


def suffix_order(refs: DataFrame) -> DataFrame:
    """ref_id, rank, start: all suffixes of each sequence in order, the empty one first.

    By prefix doubling: suffixes are ranked by their first ``HEAD`` letters, and then, as long as some share a rank, by
    their own rank and that of the suffix as many letters behind as the ranks go by, so these double each round. A
    suffix that is alone at its rank is done. No row holds more than ``HEAD`` letters, whatever the length of a
    sequence. Rows of one rank may be many, so ranks come from counts that are summed up before they are ordered, and
    are handed back in portions. Short whole sequences are ordered in their rows instead. Null sequences, and those
    without ref_id, have no suffixes; ref_id is unique.
    """
    refs = refs.filter(F.col("ref_id").isNotNull())
    if not in_parts(refs):
        short, refs = short_order(refs.filter(F.length("seq") <= SHORT)), refs.filter(F.length("seq") > SHORT)
        return short if refs.isEmpty() else short.unionByName(doubled_order(refs))
    return doubled_order(refs)


def doubled_order(refs: DataFrame) -> DataFrame:
    """``suffix_order`` by doubling, of sequences of any length."""
    size = lengths(refs).filter(F.col("ref_length").isNotNull())
    parts = cut(refs, BLOCK, HEAD)
    each = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("part"), F.lit(BLOCK)) - 1), lambda i: F.struct((F.col("from") + i).alias("start"), F.substring("part", i + 1, HEAD).alias("head"))))
    rows = parts.select("ref_id", each.alias("x")).select("ref_id", "x.*")
    rows = written(rows.unionByName(size.select("ref_id", F.col("ref_length").cast("long").alias("start"), F.lit("").alias("head"))), "suffix-heads")
    groups = rows.groupBy("ref_id", "head").agg(F.count(F.lit(1)).alias("n"))
    groups = running_total(groups, ["ref_id", "head"], "n", "rank").withColumn("often", F.col("n"))
    open_ = written(spread_join(rows, written(groups, "suffix-groups"), ["ref_id", "head"], "often", ["start"]).select("ref_id", "start", "rank", (F.col("n") > 1).alias("open")), "suffix-ranks")
    done, step = open_.filter("not open").drop("open"), HEAD
    open_ = open_.filter("open").drop("open")
    while not open_.isEmpty():
        behind = done.unionByName(open_).select("ref_id", (F.col("start") - step).alias("start"), F.col("rank").alias("next"))
        rows = written(open_.join(behind, ["ref_id", "start"], "left").fillna(-1, ["next"]), "suffix-pairs")
        groups = running_total(rows.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")), ["rank", "next"], "n", "upto")
        groups = written(groups, "suffix-groups")
        first = groups.groupBy("rank").agg(F.min("upto").alias("first"), F.count(F.lit(1)).alias("often"))
        groups = spread_join(groups, written(first, "suffix-first"), ["rank"], "often", ["next"])
        groups = written(groups.select("rank", "next", "n", F.col("n").alias("often"), (F.col("rank") + F.col("upto") - F.col("first")).alias("new")), "suffix-new")
        ranked = spread_join(rows, groups, ["rank", "next"], "often", ["start"]).select("ref_id", "start", F.col("new").alias("rank"), (F.col("n") > 1).alias("open"))
        ranked, step = written(ranked, "suffix-ranks"), 2 * step
        done = done.unionByName(ranked.filter("not open").drop("open"))
        open_ = ranked.filter("open").drop("open")
    first = done.groupBy("ref_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("often"))
    out = spread_join(done, written(first, "suffix-first"), ["ref_id"], "often", ["start"])
    return out.select("ref_id", (F.col("rank") - F.col("first")).alias("rank"), F.col("start").cast("int").alias("start"))


def suffix_bounds(order: DataFrame, hits: DataFrame) -> DataFrame:
    """ref_id, pattern_id, left, right: the ranks, right excluded, of the suffixes that begin with a pattern.

    ``order`` as from ``suffix_order``, ``hits`` (ref_id, pattern_id, pos) as from ``exact_find``, without repeated rows.
    A pattern that occurs nowhere has no row.
    """
    found = hits.join(order.withColumnRenamed("start", "pos"), ["ref_id", "pos"])
    return found.groupBy("ref_id", "pattern_id").agg(F.min("rank").alias("left"), (F.max("rank") + 1).alias("right"))
