"""Reading references and paired reads, and writing results, as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.sources.files import LineSink, ReferenceSource, posix
from strandloom.sources.shared import written

#: Lines that one running sum covers.
STRETCH = 1 << 20


def lines(text: str = "value"):
    """A column's lines as an array; a line break at the very end opens no line."""
    parts = F.split(F.col(text), "\n", -1)
    return F.when(F.col(text).endswith("\n") | (F.col(text) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def concat_lines(df: DataFrame, text: str = "value") -> DataFrame:
    """Adds ``seq``: all lines but the first, put together as they are. Null stays null."""
    parts = lines(text)
    return df.withColumn("seq", F.when(F.col(text).isNotNull(), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "")))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: ref_id (its path), seq. The first line is dropped, whatever it holds."""
    return concat_lines(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("ref_id"), "value")).select("ref_id", "seq")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (from 0), line of every line of the files under ``path``; files may be read in many parts.

    Rows of a part are numbered as they come; parts are put in order by where they begin in their file.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    rows = written(rows, "text-lines")  # the numbers are fixed from here on
    parts = rows.groupBy("file", "part").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))  # a row a part
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")
    return rows.join(parts.withColumn("before", before), ["file", "part"]).select("file", (F.col("before") + F.col("id") - F.col("low")).alias("at"), "line")


def reference_parts(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """ref_id, from, part of the references in ``path``, a file or folder: parts that follow each other without gaps.

    As ``read_reference``, but no task reads a whole file: files that all machines see are read by ranges of ``size``
    bytes, others by Spark's own splits into lines. What comes before a part is summed up over ranges and splits, a row
    each. A file may begin with an empty part, which is all of one without sequence.
    """
    local = posix(spark, path)
    if local is None:
        return split_parts(spark, path)
    spark.dataSource.register(ReferenceSource)
    read = spark.read.format("reference_ranges").option("path", local)
    rows = written((read.option("range", str(size)) if size else read).load(), "reference-ranges")
    sums = rows.groupBy("ref_id", "range").agg(F.sum(F.length("part")).alias("n"))  # a row a range
    base = F.sum("n").over(Window.partitionBy("ref_id").orderBy("range")) - F.col("n")
    sums = sums.select("ref_id", "range", base.alias("base"))
    return rows.join(sums, ["ref_id", "range"]).filter("part != '' or range = 0").select("ref_id", (F.col("base") + F.col("before")).alias("from"), "part")


def split_parts(spark: SparkSession, path: str) -> DataFrame:
    """What ``reference_parts`` gives, a line a part, for files that only Spark's readers reach."""
    rows = numbered_lines(spark, path)
    rows = rows.withColumn("line", F.when(F.col("at") == 0, "").otherwise(F.col("line")))
    # Lines are summed up within stretches of their numbers, and these in turn.
    rows = rows.withColumn("stretch", F.expr(f"at div {STRETCH}"))
    sums = rows.groupBy("file", "stretch").agg(F.sum(F.length("line")).alias("n"))
    base = F.sum("n").over(Window.partitionBy("file").orderBy("stretch")) - F.col("n")
    upto = F.sum(F.length("line")).over(Window.partitionBy("file", "stretch").orderBy("at")) - F.length("line")
    rows = rows.withColumn("upto", upto).join(sums.select("file", "stretch", base.alias("base")), ["file", "stretch"])
    return rows.filter("line != '' or at = 0").select(F.col("file").alias("ref_id"), (F.col("base") + F.col("upto")).alias("from"), F.col("line").alias("part"))


def pair_records(records: DataFrame) -> DataFrame:
    """read_idx, pair_id, mate, label, seq from records (file, rec from 0, label, seq); an odd last one of a file goes.

    Files follow each other in order of their names.
    """
    files = records.groupBy("file").agg((F.floor(F.count(F.lit(1)) / 2) * 2).alias("n"))  # a row a file
    files = files.withColumn("before", F.sum("n").over(Window.orderBy("file")) - F.col("n"))
    kept = records.join(files, "file").filter(F.col("rec") < F.col("n"))
    idx = (F.col("before") + F.col("rec")).cast("long")
    return kept.select(idx.alias("read_idx"), F.floor(idx / 2).alias("pair_id"), (idx % 2).cast("int").alias("mate"), "label", "seq")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads of files of label and sequence lines in turn; in each file records 2i and 2i + 1 are mates. A label at
    the end has an empty sequence. Blank lines are lines; an empty file has no reads."""
    rows = numbered_lines(spark, path)
    records = rows.groupBy("file", F.expr("at div 2").alias("rec")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("line"))).alias("label"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("line"))), F.lit("")).alias("seq"))
    return pair_records(records)


def mean_read_length(reads: DataFrame) -> DataFrame:
    """One row: mean_read_length, the whole part of all lengths over the number of reads (null without reads)."""
    return reads.agg(F.expr("sum(length(seq)) div nullif(count(1), 0)").alias("mean_read_length"))


def write_lines(df: DataFrame, column: str, order: list, path: str) -> None:
    """One text file with ``column`` in ``order``, a line each; a folder of such files where only Spark's writers reach.

    Rows are dealt by ranges, and each line's place in the file is summed up within its range and over the ranges, a
    row each; all tasks then write at once. Null lines are left out. A file of that name is replaced.
    """
    spark, rows = df.sparkSession, df.filter(F.col(column).isNotNull())
    local = posix(spark, path)
    if local is None:
        rows.orderBy(*order).select(column).write.mode("overwrite").text(path)
        return
    own = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(column).cast("string").alias("line"), F.spark_partition_id().alias("range"), own.alias("at"))
    dealt = written(dealt.withColumn("size", F.octet_length("line") + 1), "line-ranges")
    sums = dealt.groupBy("range").agg(F.sum("size").alias("n"))
    before = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a partition
    upto = F.sum("size").over(Window.partitionBy("range").orderBy("at")) - F.col("size")
    out = dealt.withColumn("upto", upto).join(F.broadcast(before), "range").select((F.col("before") + F.col("upto")).alias("offset"), "line")
    spark.dataSource.register(LineSink)
    out.write.format("ordered_lines").option("path", local).mode("overwrite").save()
