"""Listing watched folders with Spark's own reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text


def listing(spark: SparkSession, roots: list[str], content: bool = False, most_bytes: int | None = None) -> DataFrame:
    """path, size, mtime (and content) of the files under roots, noise left out, each path once.

    The column content is read only where asked for, and only of files up to most_bytes.
    """
    parts = []
    for root in roots:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        plain = F.regexp_replace("path", "^file:/*", "/")
        rows = rows.withColumns({"_path": plain, "_root": F.lit(root.removeprefix("file://").rstrip("/"))})
        rows = rows.where(~text.is_noise_file(F.col("_path")) & ~text.in_noise_dir(F.col("_path"), F.col("_root")))
        if most_bytes is not None:
            rows = rows.where(F.col("length") <= most_bytes)
        parts.append(rows.select(F.col("_path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else [])))
    return reduce(DataFrame.union, parts).dropDuplicates(["path"])
