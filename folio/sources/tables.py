"""The catalogue as parquet tables in one folder, each generation beside the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.changes import guarded
from folio.schema import SCHEMA_VERSION, TABLES, Catalogue

_NAMES = ("assets", "versions", "observed_files", "previews", "grouping_decisions", "tickets", "watched_folders")
_CONTENT = ("chunks", "files", "file_chunks")


class SchemaTooNew(RuntimeError):
    """The tables were written by a later version."""


def empty(spark: SparkSession) -> Catalogue:
    return Catalogue(**{n: spark.createDataFrame([], TABLES[n]) for n in (*_NAMES, *_CONTENT)})


def save(c: Catalogue, base: str, computed_from: int) -> int:
    """Write the next generation and then its number, so that a failed write leaves the last one."""
    spark = c.assets.sparkSession
    number = guarded(computed_from, current(spark, base))
    for n in (*_NAMES, *_CONTENT):
        if (df := getattr(c, n)) is not None:
            df.write.mode("overwrite").parquet(f"{base}/{number}/{n}")
    spark.createDataFrame([(number, SCHEMA_VERSION)], "generation long, schema_version int").coalesce(1).write.mode("append").parquet(f"{base}/generations")
    return number


def current(spark: SparkSession, base: str) -> int:
    try:
        last = spark.read.schema("generation long, schema_version int").parquet(f"{base}/generations").agg(F.max("generation"), F.max("schema_version")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise
    if (last[1] or 0) > SCHEMA_VERSION:
        raise SchemaTooNew(f"schema {last[1]}, known {SCHEMA_VERSION}")
    return last[0] or 0


def load(spark: SparkSession, base: str) -> Catalogue:
    """The last generation; tables that it lacks are empty."""
    number = current(spark, base)
    blank = empty(spark)

    def read(n: str) -> DataFrame:
        try:
            return spark.read.schema(TABLES[n]).parquet(f"{base}/{number}/{n}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return getattr(blank, n)
            raise

    return Catalogue(**{n: read(n) for n in (*_NAMES, *_CONTENT)}, generation=number)
