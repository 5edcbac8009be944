"""The synthetic star schema read as a catalogue, and the same mapping as SQL views.

customer are works (supplier such without versions), orders their versions and tickets, part the tracked files,
lineitem the chunks of files, embeddings the 8x8 grids behind picture hashes,
events the sightings of files. Remainders of keys shape the catalogue (contents
without pictures, never verified files); every query runs over the whole of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import similarity
from folio.schema import Catalogue

#: "Now" of the queries that need one.
NOW = "1998-09-01 00:00:00"

_PATH = "concat('/work/', p_partkey % 40, '/', p_type, '/', p_partkey, '/', p_name, '_v', p_size, ' final.psd')"
#: Three keys in a row share a content.
_HASH = "sha2(cast({} div 3 AS string), 256)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS asset_id", f"{_HASH.format('o_orderkey')} AS file_hash", "cast(floor(o_totalprice) AS bigint) AS size",
        "o_orderdate AS observed_at", "o_orderdate - INTERVAL 5 MINUTES AS modified_at", "concat('/work/', o_custkey, '/save_', o_orderkey, '.psd') AS source_path",
        "concat('/work/', o_custkey, '/file_', o_orderkey % 3, '.psd') AS file_key", "o_orderstatus <> 'F' AS content_present",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAYS END AS content_released_at", "o_orderpriority = '1-URGENT' AS pinned",
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))
    works = table(spark, sf_dir, "customer").join(dates, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr("c_custkey AS id", "c_name AS name", "created_at", "updated_at")
    return works.union(table(spark, sf_dir, "supplier").selectExpr("-s_suppkey AS id", "s_name AS name", "timestamp_ntz'1998-01-01 00:00:00'", "timestamp_ntz'1998-01-01 00:00:00'"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderkey AS version_id", "IF(o_orderkey % 2 = 0, 'waiting_on_them', 'waiting_on_me') AS direction",
        "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'maybe_done' ELSE 'closed' END AS status", "o_orderpriority AS note", "concat('Supplier#', o_orderkey % 97) AS who",
        "o_orderdate AS created_at", "CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 10 DAYS END AS flagged_at", "CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN o_orderdate + INTERVAL 20 DAYS END AS closed_at",
    )


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, grid and its mean: each embedding as an 8x8 grey picture."""
    one, most = F.lit(1).cast("float"), F.lit(127).cast("float")  # an int beside a float would make doubles, which floor differently
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x + one) * most)).alias("grid"))
    return cells.withColumn("mean", similarity.grid_mean(F.col("grid")))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = grids(spark, sf_dir).select("vec_id", similarity.grid_phash(F.col("grid"), F.col("mean")).alias("phash"))
    contents = table(spark, sf_dir, "orders").selectExpr("o_orderkey div 3 AS id").union(table(spark, sf_dir, "part").selectExpr("p_partkey div 3")).distinct()
    pictures = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("pictures"))  # one row
    keys = contents.where("id % 4 <> 3").crossJoin(F.broadcast(pictures)).withColumn("vec_id", F.col("id") % F.col("pictures"))
    return keys.join(hashes, "vec_id", "left").selectExpr(
        "sha2(cast(id AS string), 256) AS file_hash", "CASE id % 4 WHEN 2 THEN IF(id % 8 = 2, 'failed', 'unsupported') ELSE 'ok' END AS status", "'psd' AS source", "IF(id % 4 = 2, 0, 512) AS width", "IF(id % 4 = 2, 0, 256) AS height",
        "id * 10 AS bytes", "timestamp_ntz'1998-01-01 00:00:00' AS attempted_at", "IF(id % 16 = 2, 'decode', '') AS error", "IF(id % 4 = 2, '', 'png') AS format", "id % 12 = 0 AS alpha_flattened",
        "IF(id % 4 = 0, coalesce(phash, ''), '') AS phash",
    )


def observed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        f"{_PATH} AS path", "p_partkey % 150 + 1 AS asset_id", f"{_HASH.format('p_partkey')} AS last_hash", "p_size * 100000L AS last_size",
        "timestamp_ntz'1998-01-01 00:00:00' + make_dt_interval(0, 0, cast(p_partkey % 2880 AS int)) AS last_modified_at", "timestamp_ntz'1998-08-31 00:00:00' AS last_seen_at",
        "IF(p_partkey % 5 = 0, NULL, timestamp_ntz'1998-08-01 00:00:00' + make_dt_interval(0, cast(p_partkey % 700 AS int))) AS last_verified_at",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"{_PATH} AS path")
    other = paths.selectExpr("k - 40 AS k", "path AS other")
    return paths.where("k % 50 = 0").join(other, "k").selectExpr("least(path, other) AS path_a", "greatest(path, other) AS path_b", "IF(k % 100 = 0, 'together', 'apart') AS decision", "timestamp_ntz'1998-06-01 00:00:00' AS decided_at")


def watched_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("concat('/work/', n_nationkey) AS path", "timestamp_ntz'1998-01-01 00:00:00' + make_dt_interval(n_regionkey) AS added_at")


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_hash"), (F.row_number().over(order) - 1).alias("idx"), F.col("l_partkey").cast("string").alias("chunk_hash"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS string) AS hash", "cast(floor(o_totalprice) AS bigint) AS size", "1 + o_orderkey % 3 AS refcount")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left").selectExpr("cast(p_partkey AS string) AS hash", "p_size * 1024L AS size", "coalesce(n, 0L) AS refcount")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("cast(user_id AS string) AS path", "cast(floor(value) AS bigint) AS size", "ts AS mtime", "ts AS seen_at", "'free' AS open_state")


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    made = {f.__name__: f(spark, sf_dir) for f in (assets, versions, observed_files, previews, tickets, watched_folders, chunks, files, file_chunks)}
    return Catalogue(grouping_decisions=decisions(spark, sf_dir), **made)


#: The same views for DuckDB, to be put before a query.
SQL_VIEWS = r"""
WITH versions AS (
  SELECT o_orderkey AS id, o_custkey AS asset_id, sha256(CAST(o_orderkey // 3 AS VARCHAR)) AS file_hash, CAST(floor(o_totalprice) AS BIGINT) AS size,
         o_orderdate AS observed_at, o_orderdate - INTERVAL 5 MINUTE AS modified_at, '/work/' || o_custkey || '/save_' || o_orderkey || '.psd' AS source_path,
         '/work/' || o_custkey || '/file_' || (o_orderkey % 3) || '.psd' AS file_key, o_orderstatus <> 'F' AS content_present,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS content_released_at, o_orderpriority = '1-URGENT' AS pinned
  FROM orders),
assets AS (
  SELECT c_custkey AS id, any_value(c_name) AS name, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
  UNION ALL SELECT -s_suppkey, s_name, TIMESTAMP '1998-01-01', TIMESTAMP '1998-01-01' FROM supplier),
tickets AS (
  SELECT o_orderkey AS id, o_orderkey AS version_id, CASE WHEN o_orderkey % 2 = 0 THEN 'waiting_on_them' ELSE 'waiting_on_me' END AS direction,
         CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'maybe_done' ELSE 'closed' END AS status, o_orderpriority AS note, 'Supplier#' || (o_orderkey % 97) AS who,
         o_orderdate AS created_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 10 DAY END AS flagged_at,
         CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN o_orderdate + INTERVAL 20 DAY END AS closed_at
  FROM orders),
grids AS (
  SELECT vec_id, cells, CAST(list_sum(cells) AS BIGINT) // 64 AS mean
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((x + CAST(1 AS FLOAT)) * CAST(127 AS FLOAT)) AS BIGINT)) AS cells FROM embeddings)),
hashes AS (
  SELECT vec_id, array_to_string(list_transform(range(8), lambda b: format('{:02x}', CAST(list_sum(list_transform(range(8), lambda k: CASE WHEN cells[8 * b + k + 1] >= mean THEN 1 << k ELSE 0 END)) AS BIGINT))), '') AS phash
  FROM grids),
previews AS (
  SELECT sha256(CAST(k AS VARCHAR)) AS file_hash, CASE k % 4 WHEN 2 THEN CASE WHEN k % 8 = 2 THEN 'failed' ELSE 'unsupported' END ELSE 'ok' END AS status, 'psd' AS source,
         CASE WHEN k % 4 = 2 THEN 0 ELSE 512 END AS width, CASE WHEN k % 4 = 2 THEN 0 ELSE 256 END AS height, k * 10 AS bytes, TIMESTAMP '1998-01-01' AS attempted_at,
         CASE WHEN k % 16 = 2 THEN 'decode' ELSE '' END AS error, CASE WHEN k % 4 = 2 THEN '' ELSE 'png' END AS format, k % 12 = 0 AS alpha_flattened,
         CASE WHEN k % 4 = 0 THEN coalesce(phash, '') ELSE '' END AS phash
  FROM (SELECT o_orderkey // 3 AS k FROM orders UNION SELECT p_partkey // 3 FROM part) LEFT JOIN hashes ON vec_id = k % (SELECT count(*) FROM embeddings) WHERE k % 4 <> 3),
paths AS (
  SELECT p_partkey AS k, '/work/' || (p_partkey % 40) || '/' || p_type || '/' || p_partkey || '/' || p_name || '_v' || p_size || ' final.psd' AS path, p_size FROM part),
observed_files AS (
  SELECT path, k % 150 + 1 AS asset_id, sha256(CAST(k // 3 AS VARCHAR)) AS last_hash, CAST(p_size AS BIGINT) * 100000 AS last_size,
         TIMESTAMP '1998-01-01' + to_minutes(k % 2880) AS last_modified_at, TIMESTAMP '1998-08-31' AS last_seen_at,
         CASE WHEN k % 5 <> 0 THEN TIMESTAMP '1998-08-01' + to_hours(k % 700) END AS last_verified_at
  FROM paths),
decisions AS (
  SELECT least(a.path, b.path) AS path_a, greatest(a.path, b.path) AS path_b, CASE WHEN a.k % 100 = 0 THEN 'together' ELSE 'apart' END AS decision, TIMESTAMP '1998-06-01' AS decided_at
  FROM paths a JOIN paths b ON b.k = a.k + 40 WHERE a.k % 50 = 0),
watched_folders AS (SELECT '/work/' || n_nationkey AS path, TIMESTAMP '1998-01-01' + to_days(n_regionkey) AS added_at FROM nation),
file_chunks AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS file_hash, CAST(l_partkey AS VARCHAR) AS chunk_hash,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS idx
  FROM lineitem),
files AS (SELECT CAST(o_orderkey AS VARCHAR) AS hash, CAST(floor(o_totalprice) AS BIGINT) AS size, 1 + o_orderkey % 3 AS refcount FROM orders),
chunks AS (
  SELECT CAST(p_partkey AS VARCHAR) AS hash, CAST(p_size AS BIGINT) * 1024 AS size, coalesce(n, 0) AS refcount
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
sightings AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(floor(value) AS BIGINT) AS size, ts AS mtime, ts AS seen_at, 'free' AS open_state FROM events)
"""
