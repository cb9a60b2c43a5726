"""Choosing the placement of paired reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import insertion_point
from strandloom.sources.shared import written

#: Ranges into which the places of a key with very many of them are cut.
RANGES = 256


def place_ranges(rows: DataFrame, key: str, place: str) -> DataFrame:
    """``rows`` with part: ranges of places in ascending order, by which no key is ordered in one piece.

    A key with over a thousandth of all rows is cut at its own approximate quantiles, so its parts hold about as many
    rows each, however its places lie; other keys are one part. Such keys are fewer than a thousand, and their
    quantiles, ``RANGES`` numbers each, are broadcast.
    """
    count = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = count.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(count.filter(F.col("n") * 1000 > F.lit(total)).select(key))
    cuts = rows.join(hot, key, "left_semi").groupBy(key).agg(F.percentile_approx(place, [k / RANGES for k in range(1, RANGES)]).alias("cuts"))
    rows = rows.join(F.broadcast(cuts), key, "left")
    return rows.withColumn("part", F.coalesce(insertion_point(F.array_distinct("cuts"), F.col(place)), F.lit(0))).drop("cuts")


def nearest_ahead(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, left_order, right_order, distance: for each key with rows on both sides the least positive distance from
    a left row's ``reach`` to a right row's ``place``; ties go by left, then right order.

    No pairs are made. Of the rows at one place only the first of each side can count, so they are summed up first. Both
    sides then go through one running maximum: behind a right row stands the left row that reaches farthest before it.
    The maximum runs within a part of the key's places, and over the parts' maxima, one row a part, so a key with very
    many rows is dealt out. Rows with a null key, reach or place never pair; repeated rows change nothing. No rows on a
    side: no rows.
    """
    # A left row is (reach, minus its order): the greatest is the farthest, of equals the first.
    one = left.filter(F.col(key).isNotNull() & F.col("reach").isNotNull()).groupBy(key, F.col("reach").cast("long").alias("at")).agg(F.min("ord").cast("long").alias("ord"))
    two = right.filter(F.col(key).isNotNull() & F.col("place").isNotNull()).groupBy(key, F.col("place").cast("long").alias("at")).agg(F.min("ord").cast("long").alias("ord"))
    rows = one.withColumn("side", F.lit(1)).unionByName(two.withColumn("side", F.lit(0)))
    rows = place_ranges(written(rows, "pair-places"), key, "at")
    rows = rows.withColumn("l", F.when(F.col("side") == 1, F.struct(F.col("at").alias("reach"), (-F.col("ord")).alias("o"))))
    tops = rows.groupBy(key, "part").agg(F.max("l").alias("top"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(key, "part", F.max("top").over(before).alias("carried"))
    upto = Window.partitionBy(key, "part").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)  # at the same place right rows come first
    rows = rows.withColumn("own", F.max("l").over(upto)).filter("side = 0").join(tops, [key, "part"])
    rows = rows.withColumn("l", F.coalesce("own", "carried")).filter("l is not null")  # a part's own rows reach farther
    best = rows.groupBy(key).agg(F.min(F.struct((F.col("at") - F.col("l.reach")).alias("distance"), (-F.col("l.o")).alias("left_order"), F.col("ord").alias("right_order"))).alias("b"))
    return best.select(key, "b.left_order", "b.right_order", "b.distance")


def first_success(tries: DataFrame, key: str, attempt: str, good: str) -> DataFrame:
    """The rows of ``tries`` that are ``good`` at the first attempt of their key that has any such row.

    A key without a good row has no rows; a null attempt is none.
    """
    won = tries.filter(good).groupBy(key).agg(F.min(attempt).alias("_won"))
    return tries.filter(good).join(won, key).filter(F.col(attempt) == F.col("_won")).drop("_won")


def select_pairs(maps: DataFrame, adjust) -> DataFrame:
    """The chosen mapping of each read of ``maps`` (pair_id, mate, read_idx, map_idx, mapping).

    With both mates mapped, the two placements whose distance is least and positive, or none; otherwise the first.
    Null pair ids have none. (pair_id, mate, map_idx) is unique.
    """
    rows = maps.withColumn("adjust", adjust)
    side = lambda m: rows.filter(F.col("mate") == m).withColumn("ord", F.col("map_idx"))
    left = side(0).withColumn("reach", F.col("mapping")["position"] + F.col("adjust"))
    right = side(1).withColumn("place", F.col("mapping")["position"])
    near = nearest_ahead(left, right, "pair_id")
    picked = near.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("mate"), F.col("left_order").alias("map_idx")), F.struct(F.lit(1).alias("mate"), F.col("right_order").alias("map_idx")))).alias("c")).select("pair_id", "c.*")
    mates = maps.groupBy("pair_id").agg((F.min("mate") == F.max("mate")).alias("lone"), F.min("map_idx").alias("map_idx")).filter("lone").select("pair_id", "map_idx")
    two = maps.join(picked, ["pair_id", "mate", "map_idx"])
    return two.unionByName(maps.join(mates, ["pair_id", "map_idx"]).select(two.columns))
