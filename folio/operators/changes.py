"""Changes to the catalogue as functions from tables to tables, and the rules that must hold.

Each function returns the whole new table; the caller writes it. Rules return
the rows that break them, so an empty table means that they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio import schema
from folio.functions import text
from folio.plans.components import materialize
from folio.schema import Catalogue


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """rows replace those of table with an equal key."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def with_ids(table: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """rows with ids that follow the largest of table, in the given order.

    One range-ordered numbering, written once so that both reads see the same
    ranges: rows of a task are counted, then numbered from the counts of the
    tasks before, so no task holds all rows.
    """
    base = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    parts = materialize(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each task
    return parts.join(F.broadcast(before), "_part").crossJoin(F.broadcast(base)).withColumn("id", F.col("_base") + F.col("_before") + F.col("_at") + 1).drop("_base", "_part", "_at", "_before")


# --- works and versions ------------------------------------------------------


def create_assets(assets: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """assets and a new one for each row of names(name)."""
    new = with_ids(assets, names, "name").withColumns({"created_at": now, "updated_at": now})
    return assets.unionByName(new.select(*assets.columns))


def touch_assets(assets: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """assets with updated_at = now for those of ids(id)."""
    marked = assets.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return marked.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).select(*assets.columns)


def add_versions(versions: DataFrame, rows: DataFrame) -> DataFrame:
    """versions and rows, whose content is present and whose file_key defaults to the source path."""
    key = F.when(F.coalesce("file_key", F.lit("")) == "", F.col("source_path")).otherwise(F.col("file_key"))
    new = with_ids(versions, rows, "observed_at", "source_path").withColumns({"file_key": key, "content_present": F.lit(True), "content_released_at": F.lit(None).cast(dict(versions.dtypes)["content_released_at"])})
    return versions.unionByName(new.select(*versions.columns))


def release_content(versions: DataFrame, hashes: DataFrame, now: Column) -> DataFrame:
    """The contents of hashes(file_hash) are gone: every version that still had them says since when. Repeating changes nothing."""
    marked = versions.join(hashes.select("file_hash").distinct().withColumn("_hit", F.lit(True)), "file_hash", "left")
    gone = F.coalesce("_hit", F.lit(False)) & F.col("content_present")
    return marked.withColumns({"content_released_at": F.when(gone, now).otherwise(F.col("content_released_at")), "content_present": F.col("content_present") & ~gone}).select(*versions.columns)


def set_pinned(versions: DataFrame, version_id: int, pinned: bool) -> DataFrame:
    if versions.where(F.col("id") == version_id).isEmpty():
        raise KeyError(version_id)
    return versions.withColumn("pinned", F.when(F.col("id") == version_id, pinned).otherwise(F.col("pinned")))


def rename_file_key(versions: DataFrame, renames: DataFrame) -> DataFrame:
    """renames(old, new) applied to file_key."""
    joined = versions.join(renames.select(F.col("old").alias("file_key"), F.col("new").alias("_new")), "file_key", "left")
    return joined.withColumn("file_key", F.coalesce("_new", "file_key")).select(*versions.columns)


# --- tracked files -----------------------------------------------------------


def put_observed(observed: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(observed, rows, ["path"])


def delete_observed(observed: DataFrame, paths: DataFrame) -> DataFrame:
    """Tracked files without those of paths(path); their versions stay."""
    return observed.join(paths.select("path"), "path", "left_anti").select(*observed.columns)


def move_files(c: Catalogue, moves: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """moves(path, asset_id): assets, versions and observed_files after each file and its versions went to a work, which is touched."""
    to = moves.select("path", F.col("asset_id").alias("_to"))
    observed = c.observed_files.join(to, "path", "left").withColumn("asset_id", F.coalesce("_to", "asset_id")).select(*c.observed_files.columns)
    versions = c.versions.join(to.withColumnRenamed("path", "file_key"), "file_key", "left").withColumn("asset_id", F.coalesce("_to", "asset_id")).select(*c.versions.columns)
    return touch_assets(c.assets, moves.select(F.col("asset_id").alias("id")), now), versions, observed


def delete_empty_assets(c: Catalogue, ids: DataFrame | None = None) -> DataFrame:
    """assets without those (of ids(id), or all) that have neither versions nor tracked files."""
    used = c.versions.select(F.col("asset_id").alias("id")).union(c.observed_files.select("asset_id")).distinct()
    empty = c.assets.select("id").join(used, "id", "left_anti")
    return c.assets.join(empty if ids is None else empty.join(ids, "id", "left_semi"), "id", "left_anti").select(*c.assets.columns)


# --- pictures ----------------------------------------------------------------


def put_previews(previews: DataFrame, rows: DataFrame) -> DataFrame:
    """rows replace equal contents' rows, which keep the picture hash that they had."""
    old = previews.select("file_hash", F.col("phash").alias("_old"))
    return upsert(previews, rows.join(old, "file_hash", "left").withColumn("phash", F.coalesce("_old", "phash", F.lit(""))).select(*previews.columns), ["file_hash"])


def set_phash(previews: DataFrame, hashes: DataFrame) -> DataFrame:
    """hashes(file_hash, phash) put into previews."""
    new = hashes.select("file_hash", F.col("phash").alias("_new"))
    return previews.join(new, "file_hash", "left").withColumn("phash", F.coalesce("_new", "phash")).select(*previews.columns)


# --- decisions ---------------------------------------------------------------


def put_decisions(decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(a, b, decision, decided_at), in either order of the pair; the last decision about a pair counts."""
    new = rows.where("a <> b").groupBy(F.least("a", "b").alias("path_a"), F.greatest("a", "b").alias("path_b")).agg(F.max(F.struct("decided_at", "decision")).alias("_last"))
    return upsert(decisions, new.select("path_a", "path_b", "_last.decision", "_last.decided_at"), ["path_a", "path_b"])


def rename_in_decisions(decisions: DataFrame, renames: DataFrame) -> DataFrame:
    """renames(old, new) on both sides. A pair that exists already keeps its decision; a file with itself drops out."""
    side = lambda name: renames.select(F.col("old").alias(name), F.col("new").alias(f"_{name}"))
    moved = decisions.join(side("path_a"), "path_a", "left").join(side("path_b"), "path_b", "left")
    a, b = F.coalesce("_path_a", "path_a"), F.coalesce("_path_b", "path_b")
    moved = moved.select(F.least(a, b).alias("path_a"), F.greatest(a, b).alias("path_b"), "decision", "decided_at", (F.col("_path_a").isNotNull() | F.col("_path_b").isNotNull()).alias("_moved"))
    order = Window.partitionBy("path_a", "path_b").orderBy("_moved", F.desc("decided_at"), "decision")
    return moved.where("path_a <> path_b").withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*decisions.columns)


# --- tickets -----------------------------------------------------------------


def add_tickets(tickets: DataFrame, rows: DataFrame) -> DataFrame:
    """tickets and rows(version_id, direction, note, who, created_at), which need a note and a known direction."""
    bad = rows.where(~F.coalesce(F.col("direction").isin(*schema.DIRECTIONS), F.lit(False)) | (F.coalesce("note", F.lit("")) == ""))
    if not bad.isEmpty():
        raise ValueError("a ticket needs a note and a known direction")
    kinds = dict(tickets.dtypes)
    new = with_ids(tickets, rows, "created_at", "version_id").withColumns({"status": F.lit("open"), "flagged_at": F.lit(None).cast(kinds["flagged_at"]), "closed_at": F.lit(None).cast(kinds["closed_at"])})
    return tickets.unionByName(new.select(*tickets.columns))


def set_ticket_status(tickets: DataFrame, ticket_id: int, status: str, now: Column) -> DataFrame:
    """closed_at is now for a closed ticket and null otherwise; flagged_at stays."""
    if status not in schema.TICKET_STATUSES:
        raise ValueError(status)
    hit = F.col("id") == ticket_id
    return tickets.withColumns({"closed_at": F.when(hit, now if status == "closed" else F.lit(None)).otherwise(F.col("closed_at")), "status": F.when(hit, status).otherwise(F.col("status"))})


def flag_tickets(tickets: DataFrame, versions: DataFrame, new_versions: DataFrame) -> DataFrame:
    """What newly added versions do: open tickets on other versions of their work become maybe_done, flagged at the first one's instant.

    New versions are reduced to one row for each work before they meet the tickets.
    """
    first = new_versions.groupBy("asset_id").agg(F.min(F.struct("id", "observed_at")).alias("first"), F.max("id").alias("last_id"), F.count("*").alias("n"))
    second = new_versions.join(first.select("asset_id", "first"), "asset_id").where(F.col("id") > F.col("first.id")).groupBy("asset_id").agg(F.min(F.struct("id", "observed_at")).alias("second"))
    of = versions.select(F.col("id").alias("version_id"), "asset_id").union(new_versions.select("id", "asset_id"))
    rows = tickets.join(of, "version_id", "left").join(first, "asset_id", "left").join(second, "asset_id", "left")
    at = F.when(F.col("first.id") != F.col("version_id"), F.col("first.observed_at")).otherwise(F.col("second.observed_at"))
    hit = (F.col("status") == "open") & at.isNotNull()
    return rows.withColumns({"flagged_at": F.when(hit, at).otherwise(F.col("flagged_at")), "status": F.when(hit, "maybe_done").otherwise(F.col("status"))}).select(*tickets.columns)


def flags_of_history(versions: DataFrame, tickets: DataFrame) -> DataFrame:
    """id, flagged_at: for each ticket whether a version of its work was added after its own, and when the first one was observed.

    Versions are added in the order of their ids; the next one is a window over each work.
    """
    after = Window.partitionBy("asset_id").orderBy("id")
    following = versions.select(F.col("id").alias("version_id"), F.lead("observed_at").over(after).alias("flagged_at"))
    return tickets.select("id", "version_id").join(following, "version_id").where(F.col("flagged_at").isNotNull()).select("id", "flagged_at")


# --- folders -----------------------------------------------------------------


def add_folders(folders: DataFrame, rows: DataFrame) -> DataFrame:
    """folders and the cleaned ones of rows(path, added_at) that aren't there."""
    new = rows.withColumn("path", text.clean_folder(F.col("path"))).where("path IS NOT NULL").groupBy("path").agg(F.min("added_at").alias("added_at"))
    return folders.unionByName(new.join(folders.select("path"), "path", "left_anti").select(*folders.columns))


def remove_folder(folders: DataFrame, path: str) -> DataFrame:
    return folders.where(F.col("path") != path)


# --- rules -------------------------------------------------------------------


def lost_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Versions are permanent: those that went."""
    return before.join(after.select("id"), "id", "left_anti")


def versions_without_key(versions: DataFrame) -> DataFrame:
    return versions.where(F.coalesce("file_key", F.lit("")) == "")


def tickets_without_version(c: Catalogue) -> DataFrame:
    return c.tickets.join(c.versions.select(F.col("id").alias("version_id")), "version_id", "left_anti")


def rows_without_asset(c: Catalogue) -> DataFrame:
    """Versions and tracked files of a work that isn't there: table and asset_id."""
    known = c.assets.select(F.col("id").alias("asset_id"))
    lost = lambda df, name: df.select("asset_id").join(known, "asset_id", "left_anti").select(F.lit(name).alias("table"), "asset_id")
    return lost(c.versions, "versions").union(lost(c.observed_files, "observed_files"))


def bad_values(c: Catalogue) -> DataFrame:
    """Rows with a value that its column doesn't allow: table and key."""
    bad = lambda df, name, key, ok: df.where(~F.coalesce(ok, F.lit(False))).select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"))
    out = bad(c.previews, "previews", "file_hash", F.col("status").isin(*schema.PREVIEW_STATUSES) & F.col("format").isin(*schema.PREVIEW_FORMATS))
    out = out.union(bad(c.tickets, "tickets", "id", F.col("status").isin(*schema.TICKET_STATUSES) & F.col("direction").isin(*schema.DIRECTIONS)))
    out = out.union(bad(c.grouping_decisions, "grouping_decisions", "path_a", F.col("decision").isin(*schema.DECISIONS) & (F.col("path_a") < F.col("path_b"))))
    for name in ("chunks", "files"):
        if (df := getattr(c, name)) is not None:
            out = out.union(bad(df, name, "hash", F.col("refcount") >= 0))
    return out


class Stale(RuntimeError):
    """The catalogue changed since the generation that a change was computed from."""


def guarded(computed_from: int, now: int) -> int:
    """The next generation, if none came between."""
    if computed_from != now:
        raise Stale(f"computed from {computed_from}, now {now}")
    return now + 1
