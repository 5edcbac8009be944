"""Tables of the catalogue, their allowed values, and the settings of the pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

SCHEMA_VERSION = 9

#: Column lists in Spark DDL; instants are TIMESTAMP in UTC.
TABLES = {
    "assets": "id BIGINT, name STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "versions": "id BIGINT, asset_id BIGINT, file_hash STRING, size BIGINT, observed_at TIMESTAMP, modified_at TIMESTAMP, source_path STRING, file_key STRING, content_present BOOLEAN, content_released_at TIMESTAMP, pinned BOOLEAN",
    "observed_files": "path STRING, asset_id BIGINT, last_hash STRING, last_size BIGINT, last_modified_at TIMESTAMP, last_seen_at TIMESTAMP, last_verified_at TIMESTAMP",
    "previews": "file_hash STRING, status STRING, source STRING, width INT, height INT, bytes BIGINT, attempted_at TIMESTAMP, error STRING, format STRING, alpha_flattened BOOLEAN, phash STRING",
    "grouping_decisions": "path_a STRING, path_b STRING, decision STRING, decided_at TIMESTAMP",
    "tickets": "id BIGINT, version_id BIGINT, direction STRING, status STRING, note STRING, who STRING, created_at TIMESTAMP, flagged_at TIMESTAMP, closed_at TIMESTAMP",
    "watched_folders": "path STRING, added_at TIMESTAMP",
    "chunks": "hash STRING, size BIGINT, refcount BIGINT",
    "files": "hash STRING, size BIGINT, refcount BIGINT",
    "file_chunks": "file_hash STRING, idx INT, chunk_hash STRING",
    "chunk_data": "hash STRING, content BINARY",
    "thumbs": "file_hash STRING, format STRING, data BINARY",
    "sightings": "path STRING, size BIGINT, mtime TIMESTAMP, seen_at TIMESTAMP, open_state STRING",
}
#: Columns whose values identify a row.
KEYS = {
    "assets": ["id"], "versions": ["id"], "observed_files": ["path"], "previews": ["file_hash"], "grouping_decisions": ["path_a", "path_b"],
    "tickets": ["id"], "watched_folders": ["path"], "chunks": ["hash"], "files": ["hash"], "file_chunks": ["file_hash", "idx"], "chunk_data": ["hash"], "thumbs": ["file_hash", "format"],
}

DIRECTIONS = ("waiting_on_them", "waiting_on_me")
TICKET_STATUSES = ("open", "maybe_done", "closed")
PREVIEW_STATUSES = ("ok", "unsupported", "failed")
PREVIEW_FORMATS = ("png", "jpeg", "")
DECISIONS = ("together", "apart")
OPEN_STATES = ("free", "locked", "unknown")


@dataclass(frozen=True)
class Weights:
    """How much each signal counts for a pair of files, and where the lines are."""

    name: float = 0.70
    time: float = 0.10
    image: float = 0.20
    threshold: float = 0.62
    time_window_s: int = 8 * 3600
    similar_image: int = 10
    different_image: int = 26


@dataclass(frozen=True)
class IngestConfig:
    quiet_s: int = 3
    quiet_scale_bytes: int = 10 << 20
    quiet_max_s: int = 300
    verify_every_s: int = 3600
    poll_s: int = 1
    open_attempts: int = 5
    regroup_gap_s: int = 30


@dataclass(frozen=True)
class PreviewLimits:
    edge: int = 512
    png_bytes: int = 256 << 10
    source_bytes: int = 512 << 20
    pixels: int = 320 << 20
    zip_entries: int = 4096
    merged_bytes: int = 64 << 20
    psd_edge: int = 30000
    psd_channels: int = 56


@dataclass
class Catalogue:
    """All tables of a catalogue as DataFrames, and its commit number."""

    assets: DataFrame
    versions: DataFrame
    observed_files: DataFrame
    previews: DataFrame
    grouping_decisions: DataFrame
    tickets: DataFrame
    watched_folders: DataFrame
    chunks: DataFrame | None = None
    files: DataFrame | None = None
    file_chunks: DataFrame | None = None
    generation: int = 1
