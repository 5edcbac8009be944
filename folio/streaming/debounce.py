"""Save detection on a stream of sightings, and the loop around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.schema import IngestConfig

SETTLED = "path string, size long, mtime timestamp, settled_at timestamp"


class Debounce(StatefulProcessor):
    """For each path: a size and time that stay as they are for the quiet time settle once; any change starts over."""

    def __init__(self, cfg: IngestConfig = IngestConfig()):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "size long, mtime long, since long, settled boolean")

    def quiet_us(self, size: int) -> int:
        c = self.cfg
        scaled = size // c.quiet_scale_bytes if c.quiet_scale_bytes > 0 else 0
        return min(max(scaled, c.quiet_s), c.quiet_max_s if c.quiet_scale_bytes > 0 else c.quiet_s) * 1_000_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True).sort_values("seen_at", kind="stable")
        state = self.last.get() if self.last.exists() else None
        out = []
        for size, mtime, at in zip(seen["size"].tolist(), _us(seen["mtime"]), _us(seen["seen_at"]), strict=True):
            if state is None or (state[0], state[1]) != (size, mtime):
                state = (size, mtime, at, False)
            elif not state[3] and at - state[2] >= self.quiet_us(size):
                state = (size, mtime, state[2], True)
                out.append((key[0], size, pd.Timestamp(mtime, unit="us"), pd.Timestamp(at, unit="us")))
        if state is not None:
            self.last.update(state)
        yield pd.DataFrame(out, columns=["path", "size", "mtime", "settled_at"]).astype({"path": object, "size": "int64", "mtime": "datetime64[us]", "settled_at": "datetime64[us]"})

    def close(self) -> None:
        pass


def _us(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def settled(sightings: DataFrame, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """A stream of settled saves from a stream of sightings(path, size, mtime, seen_at). Needs the RocksDB state store."""
    return sightings.select("path", "size", "mtime", "seen_at").groupBy("path").transformWithStateInPandas(Debounce(cfg), SETTLED, "Append", "None")


def needs(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Vanish(StatefulProcessor):
    """For each path: forgotten once it has been missing for the quiet time; seeing it again starts over."""

    def __init__(self, cfg: IngestConfig = IngestConfig()):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        since, out = (self.since.get()[0] if self.since.exists() else None), []
        for present, at in zip(seen["present"].tolist(), _us(seen["at"]), strict=True):
            if present:
                since = None
            elif since is None:
                since = at
            elif at - since >= self.cfg.quiet_s * 1_000_000:
                out.append((key[0], pd.Timestamp(at, unit="us")))
                since = None
        if since is None:
            self.since.clear()
        else:
            self.since.update((since,))
        yield pd.DataFrame(out, columns=["path", "forgotten_at"]).astype({"path": object, "forgotten_at": "datetime64[us]"})

    def close(self) -> None:
        pass


def forgotten(presence: DataFrame, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """A stream of forgotten paths from a stream of presence(path, present, at), one row for each tracked path and scan."""
    return presence.select("path", "present", "at").groupBy("path").transformWithStateInPandas(Vanish(cfg), "path string, forgotten_at timestamp", "Append", "None")


def watch(saves: DataFrame, scan: Callable[[DataFrame, int], None], checkpoint: str, after_scan: Callable[[int], None] | None = None, cfg: IngestConfig = IngestConfig(), available_now: bool = False):
    """Run scan on each micro-batch of settled saves, and after_scan only when it ended well; once a poll interval, or over what is there."""

    def each(batch: DataFrame, number: int) -> None:
        scan(batch, number)
        if after_scan is not None:
            after_scan(number)

    writer = saves.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{cfg.poll_s} seconds")).start()


def sightings_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Sightings appended to a folder as parquet; instants become time-zoned ones."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, k in rows.dtypes if k.startswith("timestamp")})
