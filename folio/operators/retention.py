"""Thinning of old contents, and what a copy of the store elsewhere lacks.

The policy is specified, but which version of a bucket survives and the time
zone of a day are not: here the newest one does, in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.operators import catalogue
from folio.schema import Catalogue


def bucket(observed_at: Column, now: Column) -> Column:
    """What a version shares its place with: itself for 7 days, then its day, week or month."""
    age = F.datediff(now, observed_at)
    key = lambda unit: F.concat(F.lit(f"{unit}:"), F.date_format(F.date_trunc(unit, observed_at), "yyyy-MM-dd"))
    return F.when(age <= 7, "all").when(age <= 30, key("day")).when(age <= 365, key("week")).otherwise(key("month"))


def immune(c: Catalogue) -> DataFrame:
    """Versions that are never thinned: the newest of each work, pinned ones, those with a ticket that isn't closed. id and reasons."""
    newest = catalogue.latest_version(c.versions.select("id", "asset_id", "observed_at")).select("id", F.lit(True).alias("newest"))
    waiting = c.tickets.where(catalogue.is_outstanding(F.col("status"))).select(F.col("version_id").alias("id")).distinct().withColumn("ticket", F.lit(True))
    rows = c.versions.select("id", "pinned").join(newest, "id", "left").join(waiting, "id", "left")
    return rows.select("id", F.coalesce("newest", F.lit(False)).alias("newest"), "pinned", F.coalesce("ticket", F.lit(False)).alias("ticket")).where("newest OR pinned OR ticket")


def thinned(c: Catalogue, now: Column) -> DataFrame:
    """id, asset_id, bucket, keep for each version whose content is still there."""
    rows = c.versions.where("content_present").select("id", "asset_id", "observed_at", bucket(F.col("observed_at"), now).alias("bucket"))
    newest = Window.partitionBy("asset_id", "bucket").orderBy(F.desc("observed_at"), F.desc("id"))
    rows = rows.withColumn("_n", F.row_number().over(newest)).join(immune(c).select("id", F.lit(True).alias("_immune")), "id", "left")
    keep = (F.col("bucket") == "all") | (F.col("_n") == 1) | F.coalesce("_immune", F.lit(False))
    return rows.select("id", "asset_id", "bucket", keep.alias("keep"))


def releasable(c: Catalogue, now: Column) -> DataFrame:
    """Contents all of whose versions may go: file_hash."""
    rows = c.versions.where("content_present").select("id", "file_hash").join(thinned(c, now).select("id", "keep"), "id")
    return rows.groupBy("file_hash").agg(F.max("keep").alias("keep")).where("NOT keep").select("file_hash")


def missing(there: DataFrame, here: DataFrame) -> DataFrame:
    """Hashes of there(hash) that here(hash) lacks."""
    return there.select("hash").distinct().join(here.select("hash"), "hash", "left_anti")


def bundle(c: Catalogue, asset_id: int) -> DataFrame:
    """The distinct chunks of a work's present versions, with their sizes: what a bundle of it must hold."""
    of = c.versions.where((F.col("asset_id") == asset_id) & F.col("content_present")).select("file_hash").distinct()
    return c.file_chunks.join(of, "file_hash", "left_semi").select(F.col("chunk_hash").alias("hash")).distinct().join(c.chunks.select("hash", "size"), "hash")
