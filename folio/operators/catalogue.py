"""Reading the catalogue: lookups, joins, counts and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text
from folio.schema import Catalogue

# --- lookups -----------------------------------------------------------------


def one(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key: a work, version, tracked file, preview or ticket. No row if it isn't there."""
    return table.where(F.col(key) == value)


def files_by_hash(observed: DataFrame, file_hash: str | Column) -> DataFrame:
    return observed.where(F.col("last_hash") == file_hash).orderBy("path")


def files_under(observed: DataFrame, prefix: str, any_case: bool = False) -> DataFrame:
    """Tracked files whose path begins with prefix; wild-card characters stand for themselves."""
    path = F.lower("path") if any_case else F.col("path")
    return observed.where(path.startswith(prefix.lower() if any_case else prefix)).orderBy("path")


def files_of_asset(observed: DataFrame, asset_id: int) -> DataFrame:
    return observed.where(F.col("asset_id") == asset_id).orderBy("path")


def stale_verified(observed: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """The files verified longest ago, before cutoff; never verified ones come first."""
    verified = F.coalesce("last_verified_at", F.lit("1970-01-01 00:00:00").cast(dict(observed.dtypes)["last_verified_at"]))
    return observed.where(verified < cutoff).orderBy(verified, "path").limit(limit)


def phash_of(previews: DataFrame, hashes: DataFrame) -> DataFrame:
    """hashes(file_hash) with each one's picture hash, "" where there is none."""
    return hashes.join(previews.select("file_hash", "phash"), "file_hash", "left").withColumn("phash", F.coalesce("phash", F.lit("")))


def decision_for(decisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b), in either order, with what was decided about them (null: nothing)."""
    known = decisions.select("path_a", "path_b", "decision")
    return pairs.withColumns({"path_a": F.least("a", "b"), "path_b": F.greatest("a", "b")}).join(known, ["path_a", "path_b"], "left").select("a", "b", "decision")


def all_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.orderBy("path_a", "path_b")


def tracked(observed: DataFrame) -> DataFrame:
    return observed.orderBy("path")


def watched(folders: DataFrame) -> DataFrame:
    return folders.orderBy("added_at", "path")


# --- versions ----------------------------------------------------------------


def latest_version(versions: DataFrame) -> DataFrame:
    """Each work's version observed last; of equal instants the larger id."""
    order = Window.partitionBy("asset_id").orderBy(F.desc("observed_at"), F.desc("id"))
    return versions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def versions_of(versions: DataFrame, asset_id: int) -> DataFrame:
    """A work's versions, oldest first."""
    return versions.where(F.col("asset_id") == asset_id).orderBy("observed_at", "id")


def asset_cards(c: Catalogue) -> DataFrame:
    """A card for each work that has a version: its latest version and picture, and its counts; newest first.

    Versions and files are counted before the joins, so nothing fans out.
    """
    latest = latest_version(c.versions.select("id", "asset_id", "file_hash", "observed_at"))
    cards = c.assets.join(latest.select(F.col("asset_id").alias("id"), F.col("id").alias("version_id"), "file_hash", "observed_at"), "id")
    n_versions = c.versions.groupBy("asset_id").agg(F.count("*").alias("n_versions")).withColumnRenamed("asset_id", "id")
    n_files = c.observed_files.groupBy("asset_id").agg(F.count("*").alias("n_files")).withColumnRenamed("asset_id", "id")
    cards = cards.join(n_versions, "id", "left").join(n_files, "id", "left").join(c.previews.select("file_hash", "status"), "file_hash", "left")
    url = text.thumb_url(F.coalesce("status", F.lit("")), F.col("file_hash"))
    return cards.select("id", "name", "updated_at", "version_id", "file_hash", "observed_at", F.coalesce("n_versions", F.lit(0)).alias("n_versions"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("status", F.lit("")).alias("preview_status"), url.alias("thumb")).orderBy(F.desc("updated_at"), F.desc("id"))


def timeline(c: Catalogue, asset_id: int | None = None) -> DataFrame:
    """Versions with what is known of their picture, newest first; of all works by default."""
    rows = c.versions if asset_id is None else c.versions.where(F.col("asset_id") == asset_id)
    rows = rows.join(c.previews.select("file_hash", "status", "width", "height", "alpha_flattened", "error"), "file_hash", "left")
    note = text.preview_note(F.col("status"), F.coalesce("alpha_flattened", F.lit(False)), F.coalesce("error", F.lit("")))
    columns = ("id", "asset_id", "file_hash", "size", "observed_at", "content_present", "pinned", "status", "width", "height")
    order = (F.desc("observed_at"), F.desc("id"))
    return rows.withColumn("note", note).select(*columns, "note").orderBy(*(order if asset_id is not None else ("asset_id", *order)))


def previews_for(c: Catalogue, asset_id: int) -> DataFrame:
    """The picture of each version of a work, oldest first; repeated contents repeat."""
    return c.versions.where(F.col("asset_id") == asset_id).select("id", "file_hash", "observed_at").join(c.previews, "file_hash").orderBy("observed_at", "id")


def hashes_without_preview(c: Catalogue, limit: int | None = None) -> DataFrame:
    """Contents that no picture was tried for, in the order of their first version."""
    bare = c.versions.select("file_hash", "observed_at", "id").join(c.previews.select("file_hash"), "file_hash", "left_anti")
    first = bare.groupBy("file_hash").agg(F.min(F.struct("observed_at", "id")).alias("first")).orderBy("first", "file_hash")
    return (first if limit is None else first.limit(limit)).select("file_hash")


# --- tickets -----------------------------------------------------------------


def tickets_by_status(tickets: DataFrame, status: str) -> DataFrame:
    return tickets.where(F.col("status") == status).orderBy("created_at", "id")


def open_tickets(tickets: DataFrame, direction: str) -> DataFrame:
    """What waits in one direction, oldest first; maybe_done doesn't wait."""
    return tickets.where((F.col("status") == "open") & (F.col("direction") == direction)).orderBy("created_at", "id")


def is_outstanding(status: Column) -> Column:
    return status != "closed"


def tickets_on(tickets: DataFrame, version_id: int) -> DataFrame:
    """A version's tickets with whether they are live (not closed), live ones and newer ones first."""
    return tickets.where(F.col("version_id") == version_id).withColumn("live", is_outstanding(F.col("status"))).orderBy(F.desc("live"), F.desc("created_at"), F.desc("id"))


def ticket_split(tickets: DataFrame) -> DataFrame:
    """version_id, live and closed: how many tickets of each kind a version has."""
    return tickets.groupBy("version_id").agg(F.count_if(is_outstanding(F.col("status"))).alias("live"), F.count_if(~is_outstanding(F.col("status"))).alias("closed"))


def versions_with_open_ticket(c: Catalogue) -> DataFrame:
    return c.versions.join(c.tickets.where(is_outstanding(F.col("status"))), c.versions["id"] == F.col("version_id"), "left_semi")


def tickets_for(c: Catalogue, asset_id: int) -> DataFrame:
    """A work's tickets, newest first."""
    of = c.versions.where(F.col("asset_id") == asset_id).select(F.col("id").alias("version_id"))
    return c.tickets.join(of, "version_id").select(*c.tickets.columns).orderBy(F.desc("created_at"), F.desc("id"))


def asset_of_ticket(c: Catalogue) -> DataFrame:
    return c.tickets.select("id", "version_id").join(c.versions.select(F.col("id").alias("version_id"), "asset_id"), "version_id").select("id", "asset_id")


def hashes_with_open_ticket(c: Catalogue) -> DataFrame:
    return versions_with_open_ticket(c).select("file_hash").distinct().orderBy("file_hash")


def ticket_views(c: Catalogue, now: Column) -> DataFrame:
    """Tickets with their work, version, age and picture, in one pass of joins."""
    v = c.versions.select(F.col("id").alias("version_id"), "asset_id", "file_hash", "source_path", "observed_at")
    a = c.assets.select(F.col("id").alias("asset_id"), F.col("name").alias("asset_name"))
    rows = c.tickets.join(v, "version_id").join(a, "asset_id", "left").join(c.previews.select("file_hash", F.col("status").alias("preview_status")), "file_hash", "left")
    age = F.greatest(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp")), F.lit(0))
    return rows.select(
        "id", "version_id", "asset_id", F.coalesce("asset_name", F.lit("")).alias("asset_name"), "direction", "status", "note", "who", "created_at", text.last_part(F.col("source_path")).alias("file_name"),
        text.age_text(age).alias("age"), text.age_days(age).alias("age_days"), text.thumb_url(F.coalesce("preview_status", F.lit("")), F.col("file_hash")).alias("thumb"),
    ).orderBy("created_at", "id")


# --- counts ------------------------------------------------------------------


def status_summary(c: Catalogue, problems: DataFrame | None = None) -> DataFrame:
    """One row: works, versions, tickets not closed, tickets to review, folders, problems."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    of_tickets = c.tickets.agg(F.count_if(is_outstanding(F.col("status"))).alias("open_tickets"), F.count_if(F.col("status") == "maybe_done").alias("to_review"))
    out = n(c.assets, "assets").crossJoin(n(c.versions, "versions")).crossJoin(of_tickets).crossJoin(n(c.watched_folders, "folders"))
    return out.crossJoin(n(problems, "problems")) if problems is not None else out.withColumn("problems", F.lit(0).cast("long"))


def dedup_savings(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bytes as saved by users and bytes as stored."""
    logical = files.agg(F.coalesce(F.sum(F.col("size") * F.col("refcount")), F.lit(0)).alias("logical_bytes"))
    return logical.crossJoin(chunks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes")))
