"""The application surface: one object over a folder of tables, a method for each thing a user does.

Reading methods return DataFrames of the last generation. Changing methods
compute new tables, write the next generation, and raise Stale if another one
came between.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import catalogue, changes, grouping, vault
from folio.schema import SCHEMA_VERSION, Catalogue, Weights
from folio.sources import tables

BUILD = {"name": "folio", "schema": SCHEMA_VERSION}


def data_dir(environment: dict[str, str] | None = None) -> str:
    """Where tables live unless told otherwise: FOLIO_HOME, or a folder under the user's data home."""
    env = os.environ if environment is None else environment
    home = env.get("XDG_DATA_HOME") or os.path.join(env.get("HOME", "/"), ".local", "share")
    return env.get("FOLIO_HOME") or os.path.join(home, "folio")


class App:
    def __init__(self, spark: SparkSession, base: str | None = None, now: Callable[[], dt.datetime] = dt.datetime.now, weights: Weights = Weights()):
        self.spark, self.base, self.clock, self.weights = spark, base or data_dir(), now, weights

    def tables(self) -> Catalogue:
        return tables.load(self.spark, self.base)

    def now(self) -> Column:
        return F.lit(self.clock()).cast("timestamp")

    def _save(self, c: Catalogue, computed_from: int) -> None:
        tables.save(c, self.base, computed_from)

    def _change(self, **parts: DataFrame) -> None:
        c = self.tables()
        self._save(Catalogue(**{**c.__dict__, **parts}), c.generation)

    # reading

    def status(self, problems: DataFrame | None = None) -> DataFrame:
        return catalogue.status_summary(self.tables(), problems)

    def list_assets(self) -> DataFrame:
        return catalogue.asset_cards(self.tables())

    def get_asset(self, asset_id: int) -> dict[str, DataFrame]:
        """The work, its timeline and its tracked files; KeyError if there is none."""
        c = self.tables()
        asset = catalogue.one(c.assets, "id", asset_id)
        if asset.isEmpty():
            raise KeyError(asset_id)
        return {"asset": asset, "timeline": catalogue.timeline(c, asset_id), "files": catalogue.files_of_asset(c.observed_files, asset_id)}

    def open_version(self, version_id: int) -> str:
        """"live", "copy" or "gone"."""
        c = self.tables()
        return vault.opening(catalogue.one(c.versions, "id", version_id), c.observed_files).first()["opens"]

    def export_version(self, version_id: int, chunk_data: DataFrame) -> tuple[str, bytes]:
        """A name for the export and the proven content; ValueError where it isn't kept or isn't whole."""
        c = self.tables()
        row = catalogue.one(c.versions, "id", version_id).withColumn("name", text.export_name(F.col("file_key"), F.col("observed_at"))).first()
        if row is None:
            raise KeyError(version_id)
        if not row["content_present"]:
            raise ValueError("the content of this version is no longer kept")
        asked = self.spark.range(1).select(F.lit(row["file_hash"]).alias("hash"))
        got = vault.restore(c.files, c.file_chunks, chunk_data, asked).first()
        if got["state"] != "ok":
            raise ValueError(f"content {text_state(got['state'])}")
        return row["name"], bytes(got["content"])

    def explain_grouping(self, a: str, b: str) -> DataFrame:
        pair = self.spark.range(1).select(F.lit(a).alias("path_a"), F.lit(b).alias("path_b"))
        return grouping.explain(self.tables(), pair, self.weights)

    def waiting_on_them(self) -> DataFrame:
        return self._views("open", "waiting_on_them")

    def waiting_on_me(self) -> DataFrame:
        return self._views("open", "waiting_on_me")

    def review_inbox(self) -> DataFrame:
        return self._views("maybe_done", None)

    def tickets_for_asset(self, asset_id: int) -> DataFrame:
        return catalogue.ticket_views(self.tables(), self.now()).where(F.col("asset_id") == asset_id).orderBy(F.desc("created_at"), F.desc("id"))

    def _views(self, status: str, direction: str | None) -> DataFrame:
        rows = catalogue.ticket_views(self.tables(), self.now()).where(F.col("status") == status)
        return rows if direction is None else rows.where(F.col("direction") == direction)

    def build_info(self) -> dict:
        return dict(BUILD)

    def reveal_data_dir(self) -> str:
        return self.base

    # changing

    def choose_folder(self, path: str) -> None:
        c = self.tables()
        new = self.spark.range(1).select(F.lit(path).alias("path"), self.now().alias("added_at"))
        self._change(watched_folders=changes.add_folders(c.watched_folders, new))

    def remove_folder(self, path: str) -> None:
        self._change(watched_folders=changes.remove_folder(self.tables().watched_folders, path))

    def pin_version(self, version_id: int, pinned: bool) -> None:
        self._change(versions=changes.set_pinned(self.tables().versions, version_id, pinned))

    def detach_file(self, path: str) -> None:
        c = self.tables()
        self._save(grouping.detach(c, path, self.now()), c.generation)

    def open_ticket(self, version_id: int, direction: str, note: str, who: str = "") -> None:
        c = self.tables()
        if catalogue.one(c.versions, "id", version_id).isEmpty():
            raise KeyError(version_id)
        row = self.spark.range(1).select(F.lit(version_id).cast("long").alias("version_id"), F.lit(direction).alias("direction"), F.lit(note).alias("note"), F.lit(who).alias("who"), self.now().alias("created_at"))
        self._change(tickets=changes.add_tickets(c.tickets, row))

    def close_ticket(self, ticket_id: int) -> None:
        self._change(tickets=changes.set_ticket_status(self.tables().tickets, ticket_id, "closed", self.now()))

    def reopen_ticket(self, ticket_id: int) -> None:
        self._change(tickets=changes.set_ticket_status(self.tables().tickets, ticket_id, "open", self.now()))


def text_state(state: str) -> str:
    return {"missing": "is not in the store", "corrupt": "is damaged"}[state]
