"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none, and on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, and survives lost executors, since no executor owns the files.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each piece.

    A single longer value makes a piece of its own: texts are never cut.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column back to back, and n + 1 offsets (null: empty)."""
    if col.null_count:
        col = pc.fill_null(col, "")
    col = pa.concat_arrays([col])  # drops a slice's offset
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[: len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def words(col: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of each text, flat, and n + 1 offsets into them (null: no words)."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if lower:
        col = pc.ascii_lower(col)
    parts = pc.ascii_split_whitespace(col)
    flat, offs = parts.flatten(), np.asarray(parts.offsets, dtype=np.int64)
    offs = offs - offs[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if full.all():
        return flat, offs
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[offs]


def word_count(text: str = "text"):
    """Number of words of a text column (null: 0), native."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list, label: str) -> DataFrame:
    """``df`` with _rank: each row's place, from 0, in ``order`` (columns or names) over the whole table.

    Rows are dealt by ranges and numbered in each; only the ranges' sizes, a row a partition, are summed up in one
    place. So a key with very many rows is numbered by many tasks, if ``order`` tells its rows apart.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = keep(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", own), label)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], often: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and never null, where a key may hold much of ``left``.

    ``often`` is a column of ``right``: how many rows of ``left`` have its key, at least. Keys with over a thousandth
    of all of these are fewer than a thousand, so their rows are broadcast; the others are shuffled. ``often`` goes.
    """
    total = right.agg(F.coalesce(F.sum(often), F.lit(0)).alias("n")).first()["n"]
    hot = right.filter(F.col(often) * 1000 > F.lit(total)).drop(often)
    right = right.drop(often)
    if hot.isEmpty():
        return left.join(right, on, how)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right, on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)
