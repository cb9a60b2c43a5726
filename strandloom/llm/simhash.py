"""SimHash near-duplicates, found by pigeonring filtering.

The 64 bits of a fingerprint lie on a ring of ``pigeonring.SEGMENTS`` segments. If two fingerprints differ in at most ``BITS``
bits, some segment starts a chain on which the first k segments together differ in at most ``k * BITS / SEGMENTS``
bits, for every k. With 9 segments and 4 bits the budgets of 1 to 9 segments are 0 0 1 1 2 2 3 3 4: the first two
segments of the chain agree, of the next two at least one, and of the next four at least two. Candidates are
therefore rows that agree in four named segments (28 bits or more); the budgets along the chain are checked before
the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import keep, slices, table, words
from strandloom.llm.components import components
from strandloom.llm.pigeonring import chain_keys, key_structs, within_budgets
from strandloom.llm.shingles import one_of_each_group

SHINGLE, SEED = 4, 42
#: Rows of one bucket that are compared in one piece; a larger bucket is dealt out as pairs of pieces.
PIECE = 2048


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, fingerprint (as a signed long) of each text."""
    digest = xxhash.xxh64_intdigest
    for batch in slices(batches, "text", 8 << 20):
        flat, offs = words(batch.column("text"))
        # Every text's words joined by single spaces, so that a shingle is a slice.
        ends = np.cumsum(np.asarray(pc.binary_length(flat), dtype=np.int64) + 1)
        body = b" ".join(flat.cast(pa.binary()).to_pylist()) + b" "
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        out = np.zeros(batch.num_rows, np.uint64)
        for k in range(batch.num_rows):
            a, b = int(offs[k]), int(offs[k + 1])
            if a == b:
                continue
            size = min(SHINGLE, b - a)
            first, last = starts[a : b - size + 1].tolist(), (ends[a + size - 1 : b] - 1).tolist()
            h = np.array([digest(body[x:y], SEED) for x, y in zip(first, last)], dtype=np.uint64)
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 16):
                part = h[at : at + (1 << 16)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fingerprint"])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long) of every row of ``docs`` (null text: no words, fingerprint 0)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(fingerprints, "doc_id long, fingerprint long")


def walk(prints: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that tie together all rows of a bucket that links of this chain connect.

    Goes from row to row: what lies near the row at hand is linked with it and leaves the rows still to be reached,
    so fewer pairs come out than rows go in, and what links connect stays connected.
    """
    a, b, rest = [], [], np.arange(len(prints))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = within_budgets(prints[rest] ^ prints[i], start)
            if len(hit):
                a.append(np.full(len(hit), i))
                b.append(rest[hit])
                todo += rest[hit].tolist()
                rest = np.delete(rest, hit)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of the buckets in a partition that is sorted by bucket (key, value, pair)."""
    starts = np.array([i for i, _ in chain_keys()])
    held: list[np.ndarray] = []

    def links(cols: list[np.ndarray], cut: np.ndarray) -> pa.RecordBatch:
        key, prints, node = cols[0], cols[3].view(np.uint64), cols[4]
        size = np.diff(cut)
        twos = cut[:-1][size == 2]
        hit = twos[within_budgets(prints[twos] ^ prints[twos + 1], starts[key[twos]])]
        a, b = [node[hit]], [node[hit + 1]]
        for i in np.flatnonzero(size > 2):
            x, y = cut[i], cut[i + 1]
            left, right = walk(prints[x:y], int(starts[key[x]]))
            a.append(node[x:y][left])
            b.append(node[x:y][right])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        cols = [np.asarray(batch.column(i)) for i in range(5)]
        if not len(cols[0]):
            continue
        held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
        change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
        if len(change):  # the last bucket may go on in the next batch
            yield links(held, np.concatenate([[0], change]))
            held = [x[change[-1] :] for x in held]
    if held and len(held[0]):
        yield links(held, np.array([0, len(held[0])]))


def near_links(prints: DataFrame, piece: int = PIECE) -> DataFrame:
    """Links a, b between the nodes of ``prints`` (node, fingerprint; one row a fingerprint).

    Not all pairs within ``pigeonring.BITS`` of each other, but enough of them to connect all that such pairs connect.
    A bucket of over ``piece`` rows is cut at random into pieces, and each two of these are compared in a group of
    their own: no group holds more than about twice ``piece`` rows, and no pair is left out.
    """
    rows = prints.select("node", "fingerprint", F.explode(key_structs("fingerprint")).alias("k")).select("k.key", "k.value", "fingerprint", "node")
    large = keep(rows.groupBy("key", "value").count().filter(F.col("count") > piece), "simhash-large")
    if large.isEmpty():
        parts = rows.withColumn("pair", F.lit(0).cast("long"))
    else:
        parts = rows.join(large, ["key", "value"], "left_anti").withColumn("pair", F.lit(0).cast("long"))
        pieces = F.ceil(F.col("count") / piece).cast("long")
        cut = rows.join(large, ["key", "value"]).withColumn("n", pieces).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda o: F.least(o, F.col("own")) * F.col("n") + F.greatest(o, F.col("own")) + 1)
        parts = parts.unionByName(cut.withColumn("pair", F.explode(pair)).drop("count", "n", "own"))
    parts = parts.select("key", "value", "pair", "fingerprint", "node").repartition("key", "value", "pair").sortWithinPartitions("key", "value", "pair")
    return parts.mapInArrow(bucket_links, "a long, b long")


def near_duplicates(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the least id reachable over links) of every row.

    Texts link at ``pigeonring.BITS`` or fewer differing bits. Null, empty and blank texts have fingerprint 0, which links like
    any other. Rows with the same fingerprint are one node, so copies never meet in pairs. A null id belongs to
    its fingerprint's component and never names it (null if there is no other). Rows that share an id keep their own
    fingerprints. Whole texts are read, however long. No rows: no rows. Other columns are ignored.
    """
    prints = keep(with_fingerprint(docs), "simhash-prints")
    nodes = keep(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).filter(F.col("node").isNotNull()), "simhash-nodes")
    found = components(near_links(nodes, piece), "simhash-components")
    named = nodes.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    named = named.select(F.col("fingerprint").alias("f"), F.coalesce("component", "node").alias("component_id"))
    named = keep(named, "simhash-named")
    out = prints.join(named, F.col("fingerprint") == F.col("f"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with alike five-word shingles stays, unchanged: the one with the least id.

    Candidates are texts with near SimHash fingerprints, found by pigeonring filtering; their shingles are compared in full.
    Documents without an id can't be named as copies and stay. Documents that share an id but not the text are judged
    one by one; of rows with the same id and text one stays. Null and empty texts are one group. No rows: no rows.
    """
    return one_of_each_group(docs)
