"""Sharding by best-fit-decreasing bin packing of groups of equal texts.

Groups are indivisible. In order of falling size each enters the shard whose remaining capacity is the tightest that
still holds it. A group as large as the fair share of what is left gets a shard of its own first, as no capacity
could make that one equal; the others fill shards of one fixed capacity, the least at which they need no more
shards than there are.

Groups of one size are alike to the packing, so it runs over the sizes and how many groups have each: what it is given
are at most sqrt(2 * bytes) rows, 14 million for 100 TB. It answers with ranges of places in the order of size, and
groups find their shard by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import keep, numbered, spread_join, table

SHARDS = 16
#: Capacities are tried in steps of this part of the fair share.
STEP = 4096
#: Places of groups in one block, which one window fills in.
BLOCK = 1 << 16


class Remaining:
    """Bins by what remains in them, as a balanced tree: the priority of a node is a hash, and the tree a heap by it.

    Nodes are [key, priority, left, right]; a key is (remaining, bin).
    """

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def split(node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = Remaining.split(node[3], key)
            node[3] = low
            return node, high
        low, high = Remaining.split(node[2], key)
        node[2] = high
        return low, node

    @staticmethod
    def merge(low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = Remaining.merge(low[3], high)
            return low
        high[2] = Remaining.merge(low, high[2])
        return high

    def add(self, remaining: int, place: int) -> None:
        key = (remaining, place)
        low, high = self.split(self.root, key)
        node = [key, (place * 2654435761 + remaining * 40503) % (1 << 32), None, None]
        self.root = self.merge(self.merge(low, node), high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The (remaining, bin) with the least remaining of ``size`` or more, of equals the first bin."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def remove(self, key: tuple[int, int]) -> None:
        low, rest = self.split(self.root, key)
        _, high = self.split(rest, (key[0], key[1] + 1))
        self.root = self.merge(low, high)


def best_fit(sizes: list[int], counts: list[int], bins: int, capacity: int) -> list[tuple[int, int, int]] | None:
    """(first place, groups, bin) in the order of ``sizes``, which fall; None if ``bins`` of ``capacity`` don't do.

    A bin that is the tightest for a size stays so until it can't hold one more, so it takes as many at once.
    An empty bin is opened only if no other one holds the size.
    """
    tree, opened, at, out = Remaining(), 0, 0, []
    for size, count in zip(sizes, counts):
        while count:
            found = tree.tightest(size)
            if found is None:
                if opened == bins or size > capacity:
                    return None
                found = (capacity, opened)
                opened += 1
            else:
                tree.remove(found)
            many = min(count, found[0] // size)
            out.append((at, many, found[1]))
            tree.add(found[0] - many * size, found[1])
            at, count = at + many, count - many
    return out


def pack(sizes: list[int], counts: list[int], bins: int) -> list[tuple[int, int, int]]:
    """(first place, groups, bin) of groups whose ``sizes`` fall, in ``bins`` bins of sizes as near equal as groups allow."""
    rest, out, lone, skip = sum(s * n for s, n in zip(sizes, counts)), [], 0, 0
    sizes, counts = list(sizes), list(counts)
    at = 0
    while skip < len(sizes) and lone < bins - 1 and sizes[skip] * (bins - lone) >= rest:  # as much as a fair share
        out.append((at, 1, lone))
        rest, lone, at = rest - sizes[skip], lone + 1, at + 1
        counts[skip] -= 1
        skip += not counts[skip]
    sizes, counts, bins = sizes[skip:], counts[skip:], bins - lone
    if not sizes:
        return out
    fair = -(-rest // bins)

    def tried(k: int) -> list[tuple[int, int, int]] | None:
        return best_fit(sizes, counts, bins, fair + -(-fair * k // STEP))

    low, high = -1, 0
    while (found := tried(high)) is None:  # twice the fair share always does
        low, high = high, max(1, 2 * high)
    while high - low > 1:
        middle = (low + high) // 2
        if (less := tried(middle)) is None:
            low = middle
        else:
            high, found = middle, less
    return out + [(at + a, n, b + lone) for a, n, b in found]


def packed(batches: Iterator[pa.RecordBatch], bins: int) -> Iterator[pa.RecordBatch]:
    """Ranges of places (from, upto, shard) for the sizes and counts of all batches, which fall in size."""
    held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if held:
        sizes, counts = (np.concatenate([h[k] for h in held]).tolist() for k in range(2))
        found = pack(sizes, counts, bins)
        for i in range(0, len(found), 1 << 16):
            a, n, shard = (np.array(x, np.int64) for x in zip(*found[i : i + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(a + n), pa.array(shard.astype(np.int32))], ["from", "upto", "shard"])


def group_shards(groups: DataFrame, bins: int) -> DataFrame:
    """group, n, shard for groups (group, n, size): each group's shard."""
    placed = numbered(groups, [F.col("size").desc(), F.col("group")], "shard-groups")
    kinds = groups.groupBy("size").agg(F.count(F.lit(1)).alias("count"))
    ranges = kinds.repartition(1).sortWithinPartitions(F.col("size").desc()).mapInArrow(lambda b: packed(b, bins), "from long, upto long, shard int")
    ranges = keep(ranges, "shard-ranges")
    # Each block of places gets the ranges that begin in it, and the one that goes on into it.
    blocks = ranges.withColumn("block", F.explode(F.sequence(F.expr(f"from div {BLOCK}"), F.expr(f"(upto - 1) div {BLOCK}"))))
    starts = blocks.select("block", F.greatest("from", F.col("block") * BLOCK).alias("at"), F.lit(0).alias("kind"), "shard", F.lit(None).cast("string").alias("group"), F.lit(None).cast("long").alias("n"))
    rows = placed.select(F.expr(f"_rank div {BLOCK}").alias("block"), F.col("_rank").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("shard"), "group", "n")
    upto = Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = starts.unionByName(rows).withColumn("shard", F.last("shard", ignorenulls=True).over(upto))
    return rows.filter("kind = 1").select("group", "n", "shard")


def packed_shards(docs: DataFrame, bins: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``: the law is `bytes`.

    Size is the text's UTF-8 bytes plus 1. Equal texts (by a 128-bit digest) share a shard; null and empty texts are
    equal, of size 1 and CRC 0. A slot is a row's place in its shard, by text's digest and id (null first). Rows that
    share an id are rows of their own. Shards differ in size by no more than their groups force; without enough
    groups some stay empty. ``grown_shard`` is null: another number of shards is packed anew. No rows: no rows.
    Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"))
    rows = keep(rows, "shard-rows")
    groups = keep(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "shard-sums")
    shards = keep(group_shards(groups, bins), "shard-of-group")
    rows = numbered(spread_join(rows, shards, ["group"], "n", "inner"), [F.col("shard"), F.col("group"), F.col("doc_id").asc_nulls_first()], "shard-slots")
    sizes = rows.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row a shard
    out = rows.join(F.broadcast(sizes), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op12_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_shards(table(spark, sf_dir, "documents"))
