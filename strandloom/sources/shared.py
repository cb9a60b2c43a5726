"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read back: computed once, and kept if executors go."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:  # one machine, as in tests
        path = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
