"""Turning a folder listing into changes of the catalogue: one scan as joins and classifications."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text
from folio.operators import changes
from folio.plans.components import materialize
from folio.schema import Catalogue, IngestConfig


def quiet_for(size: Column, cfg: IngestConfig = IngestConfig()) -> Column:
    """Seconds that a file of this size must stay as it is."""
    if cfg.quiet_scale_bytes <= 0:
        return F.lit(cfg.quiet_s).cast("long")
    return F.least(F.greatest(F.floor(size / cfg.quiet_scale_bytes), F.lit(cfg.quiet_s)), F.lit(cfg.quiet_max_s))


def worth_reading(listing: DataFrame, observed: DataFrame, now: Column, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """The rows of listing(path, size, mtime) that are new, look different, or were verified too long ago."""
    known = observed.select("path", "last_size", "last_modified_at", "last_verified_at", F.lit(True).alias("_known"))
    since = F.unix_seconds(now.cast("timestamp")) - F.coalesce(F.unix_seconds(F.col("last_verified_at").cast("timestamp")), F.lit(0))
    due = (since >= cfg.verify_every_s) if cfg.verify_every_s > 0 else F.lit(False)
    worth = F.col("_known").isNull() | (F.col("size") != F.col("last_size")) | (F.col("mtime") != F.col("last_modified_at")) | due
    return listing.join(known, "path", "left").where(worth).select(*listing.columns)


def vanished(observed: DataFrame, listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Tracked files under roots(path) that the listing doesn't show."""
    gone = observed.join(listing.select("path"), "path", "left_anti")
    parts = F.split("path", "/")
    # a file's folders are few: meet the roots by equality, not by prefix
    above = gone.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("root"))
    inside = above.join(roots.select(F.rtrim("path", F.lit("/")).alias("root")), "root", "left_semi").select("path").distinct()
    return gone.join(inside, "path", "left_semi").select(*observed.columns)


def rename_sources(new_files: DataFrame, observed: DataFrame, listing: DataFrame) -> DataFrame:
    """path, source for new_files(path, file_hash): the first tracked path of equal content that the listing no longer shows."""
    lost = observed.join(listing.select("path"), "path", "left_anti").groupBy(F.col("last_hash").alias("file_hash")).agg(F.min("path").alias("source"))
    return new_files.join(lost, "file_hash").select("path", "source")


def classify(read: DataFrame, observed: DataFrame, listing: DataFrame) -> DataFrame:
    """read(path, size, mtime, file_hash, still_same) with outcome, asset_id and rename source.

    moved: the file changed while it was read; verified: tracked with this
    content; new_version: tracked with another; renamed: not tracked, but a lost
    file had this content; new_asset: neither. Of several new files that could
    be one lost file's new name, the first is; the others are new works.
    """
    known = observed.select("path", "asset_id", "last_hash")
    rows = read.join(known, "path", "left")
    new = rows.where("asset_id IS NULL AND still_same").select("path", "file_hash")
    first = Window.partitionBy("source").orderBy("path")
    sources = rename_sources(new, observed, listing).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    lost = observed.select(F.col("path").alias("source"), F.col("asset_id").alias("_source_asset"))
    rows = rows.join(sources.join(lost, "source"), "path", "left")
    outcome = (
        F.when(~F.col("still_same"), "moved").when(F.col("last_hash") == F.col("file_hash"), "verified").when(F.col("asset_id").isNotNull(), "new_version")
        .when(F.col("source").isNotNull(), "renamed").otherwise("new_asset")
    )
    return rows.withColumns({"outcome": outcome, "asset_id": F.coalesce("asset_id", "_source_asset")}).select(*read.columns, "outcome", "asset_id", "source")


def scan_summary(outcomes: DataFrame) -> DataFrame:
    """One row with the number of files of each outcome."""
    names = ("new_version", "new_asset", "renamed", "moved", "verified")
    return outcomes.agg(*(F.count_if(F.col("outcome") == n).alias(n) for n in names))


def changed_catalogue(summary: DataFrame) -> DataFrame:
    return summary.withColumn("changed", F.col("new_version") + F.col("new_asset") + F.col("renamed") + F.coalesce(F.col("vanished") if "vanished" in summary.columns else F.lit(0), F.lit(0)) > 0)


def apply_outcomes(c: Catalogue, outcomes: DataFrame, now: Column) -> Catalogue:
    """The catalogue after a scan's outcomes, given as a written table."""
    done = outcomes.where("outcome <> 'moved'")
    renames = done.where("outcome = 'renamed'").select(F.col("source").alias("old"), F.col("path").alias("new"), "asset_id")
    versions = changes.rename_file_key(c.versions, renames)
    decisions = changes.rename_in_decisions(c.grouping_decisions, renames)
    observed = changes.delete_observed(c.observed_files, renames.select(F.col("old").alias("path")))
    renamed = c.assets.join(renames.select(F.col("asset_id").alias("id"), text.base_name(F.col("new")).alias("_name")).groupBy("id").agg(F.min("_name").alias("_name")), "id", "left")
    assets = renamed.withColumns({"updated_at": F.when(F.col("_name").isNotNull(), now).otherwise(F.col("updated_at")), "name": F.coalesce("_name", "name")}).select(*c.assets.columns)
    fresh = changes.with_ids(c.assets, done.where("outcome = 'new_asset'").select("path", text.base_name(F.col("path")).alias("name")), "path")
    assets = assets.unionByName(fresh.select("id", "name", now.alias("created_at"), now.alias("updated_at")))
    rows = done.join(fresh.select("path", F.col("id").alias("_new")), "path", "left").withColumn("asset_id", F.coalesce("asset_id", "_new"))
    saved = rows.where("outcome IN ('new_version', 'new_asset')")
    added = saved.select("asset_id", "file_hash", "size", now.alias("observed_at"), F.col("mtime").alias("modified_at"), F.col("path").alias("source_path"), F.col("path").alias("file_key"), F.lit(False).alias("pinned"))
    all_versions = changes.add_versions(versions, added)
    new_rows = all_versions.join(versions.select("id"), "id", "left_anti")
    tracked = rows.select("path", "asset_id", F.col("file_hash").alias("last_hash"), F.col("size").alias("last_size"), F.col("mtime").alias("last_modified_at"), now.alias("last_seen_at"), now.alias("last_verified_at"))
    return Catalogue(**{
        **c.__dict__, "assets": changes.touch_assets(assets, saved.select(F.col("asset_id").alias("id")), now), "versions": all_versions, "observed_files": changes.put_observed(observed, tracked),
        "grouping_decisions": decisions, "tickets": changes.flag_tickets(c.tickets, versions, new_rows), "generation": c.generation + 1,
    })


def settled_saves(sightings: DataFrame, gap_s: int | None = None, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """path, start, last, n: runs of sightings in which no gap reaches the quiet time.

    What the streaming debounce settles if scans are frequent: a gap of exactly
    the quiet time ends a run. The quiet time is gap_s, or that of the run's size.
    """
    order = Window.partitionBy("path").orderBy("seen_at", "size")
    at = F.unix_micros(F.col("seen_at").cast("timestamp"))
    quiet = (F.lit(gap_s) if gap_s is not None else quiet_for(F.lag("size").over(order), cfg)).cast("double") * 1e6
    begins = F.coalesce(at - F.lag(at).over(order) >= quiet, F.lit(True))
    runs = sightings.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(order))
    return runs.groupBy("path", "_run").agg(F.min("seen_at").alias("start"), F.max("seen_at").alias("last"), F.count("*").alias("n")).drop("_run")


def problems(attempts: DataFrame, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """path, attempts: files of attempts(path, state, at) whose last tries, unbroken by a success or change, could not open them; by path.

    A locked file waits for ever and neither counts nor clears.
    """
    last_ok = attempts.where("state = 'free'").groupBy("path").agg(F.max("at").alias("_ok"))
    bad = attempts.where("state = 'unknown'").join(last_ok, "path", "left").where("_ok IS NULL OR at > _ok")
    return bad.groupBy("path").agg(F.count("*").alias("attempts")).where(F.col("attempts") >= cfg.open_attempts).orderBy("path")


#: What scans remember of each path between them; rows of paths that are gone leave with their quiet time.
SCAN_STATE = "path string, size long, mtime timestamp, stable_since timestamp, failures long, missing_since timestamp"


@dataclass(frozen=True)
class Scan:
    """What one scan leaves: the catalogue, the state for the next one, the unreadable files, and one row of counters."""

    catalogue: Catalogue
    state: DataFrame
    problems: DataFrame
    counters: DataFrame


def scan(c: Catalogue, state: DataFrame, listing: DataFrame, roots: DataFrame, read: Callable[[DataFrame], DataFrame], now: Column, cfg: IngestConfig = IngestConfig()) -> Scan:
    """One scan over listing(path, size, mtime) of roots(path), after scans that left state (SCAN_STATE).

    read gets the files to open (path, size, mtime) and returns them with
    file_hash, still_same and open_state ("free", "locked", "unknown"). A file is
    opened once it looked the same for its quiet time, unless it could not be
    opened too often; then it waits for a change. A tracked file is forgotten when
    it was missing for the flat quiet time. Tables that later steps read more than
    once are written in between, so nothing is read from disk twice.
    """
    now = now.cast("timestamp")
    since = lambda at: F.unix_micros(now) - F.unix_micros(at.cast("timestamp"))
    before = state.select("path", F.struct("size", "mtime").alias("_look"), "stable_since", "failures")
    looks = listing.select("path", "size", F.col("mtime").cast("timestamp").alias("mtime")).join(before, "path", "left")
    same = F.coalesce(F.col("_look").eqNullSafe(F.struct("size", "mtime")) & F.col("stable_since").isNotNull(), F.lit(False))
    looks = looks.select(
        "path", "size", "mtime", F.when(same, F.col("stable_since")).otherwise(now).alias("stable_since"), F.when(same, F.col("failures")).otherwise(0).cast("long").alias("failures"),
        (same & (since(F.col("stable_since")) >= quiet_for(F.col("size"), cfg) * 1_000_000)).alias("settled"),
    )
    looks = materialize(looks, "looks")
    ripe = looks.where(F.col("settled") & (F.col("failures") < cfg.open_attempts)).select("path", "size", "mtime")
    opened = materialize(read(worth_reading(ripe, c.observed_files, now, cfg)).select("path", "size", "mtime", "file_hash", "still_same", "open_state"), "opened")
    outcomes = materialize(classify(opened.where("open_state = 'free'").drop("open_state"), c.observed_files, listing), "outcomes")
    after = apply_outcomes(c, outcomes, now)

    tried = looks.join(opened.select("path", "open_state").join(outcomes.select("path", "outcome"), "path", "left"), "path", "left")
    failures = F.when(F.col("open_state") == "unknown", F.col("failures") + 1).when(F.col("open_state") == "free", 0).otherwise(F.col("failures"))
    moved = F.coalesce(F.col("outcome") == "moved", F.lit(False))
    tried = tried.withColumns({"failures": failures, "moved": moved, "stuck": F.col("settled") & (failures >= cfg.open_attempts)})
    present = tried.where("NOT moved").select("path", "size", "mtime", "stable_since", "failures", F.lit(None).cast("timestamp").alias("missing_since"))

    tracked = after.observed_files.select("path", F.lit(True).alias("tracked"))
    known = state.join(tracked, "path", "full")
    gone = vanished(known, listing, roots).withColumns({"missing_since": F.coalesce(F.col("missing_since"), now), "tracked": F.coalesce("tracked", F.lit(False))})
    over = since(F.col("missing_since")) >= cfg.quiet_s * 1_000_000
    gone = materialize(gone.withColumn("over", F.col("missing_since").isNotNull() & over), "gone")
    elsewhere = state.join(listing.select("path"), "path", "left_anti").join(gone.select("path"), "path", "left_anti")
    left = materialize(present.unionByName(gone.where("NOT over").select(*present.columns)).unionByName(elsewhere.select(*present.columns)), "state")
    forgotten = gone.where("over AND tracked").select("path")
    after = Catalogue(**{**after.__dict__, "observed_files": changes.delete_observed(after.observed_files, forgotten)})

    busy = F.col("settled") & (F.col("moved") | (F.coalesce(F.col("open_state"), F.lit("free")) != "free"))
    counts = tried.agg(
        F.count_if(F.col("settled") & ~busy & ~F.col("stuck")).alias("settled"), F.count_if(F.col("outcome").isin("new_version", "new_asset")).alias("new_versions"), F.count_if(F.col("outcome") == "new_asset").alias("new_assets"),
        F.count_if(F.col("outcome") == "renamed").alias("renamed"), F.count_if(~F.col("settled") | (busy & ~F.col("stuck"))).alias("waiting"), F.count_if(F.col("outcome") == "verified").alias("verified"), F.count_if("stuck").alias("unreadable"),
    )
    counters = counts.crossJoin(forgotten.agg(F.count("*").alias("vanished")))  # one row each
    counters = counters.withColumn("changed", F.col("new_versions") + F.col("renamed") + F.col("vanished") > 0)
    return Scan(after, left, left.where((F.col("failures") >= cfg.open_attempts) & F.col("missing_since").isNull()).select("path", F.col("failures").alias("attempts")), counters)
