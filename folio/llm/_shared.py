"""What several operators need: tables, stable folds, texts of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.plans.components import Forest, components, discard, materialize

#: White space of the word contracts: everything else belongs to a word.
SPACES = "\x09\x0a\x0b\x0c\x0d\x20"
WORD = r"[^\x20\x09-\x0D]+"


__all__ = ["Forest", "components", "discard", "materialize"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sliced(batches, rows: int = 256):
    """Batches in slices of a few rows, so that a task holds few texts as Python objects; in the end, free memory goes back to the system."""
    import ctypes

    import pyarrow as pa

    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def join_spread(rows: DataFrame, keys: DataFrame, on: list[str], copies: str, how: str = "left") -> DataFrame:
    """rows joined with keys, which has one row for each value of `on` and in `copies` how many rows hold it.

    Keys that a 1,024th of all rows or more hold, at most 1,024 of them, go to
    every task, so that none of their rows is dealt by key; the others are joined as usual.
    """
    common = F.col(copies) * 1024 >= rows.count()
    hot = F.broadcast(keys.where(common).drop(copies))
    rest = rows.join(hot.select(*on), on, "left_anti").join(keys.where(~common).drop(copies), on, how)
    return rows.join(hot, on).unionByName(rest)


def texts_of(batch, name: str) -> list[str]:
    """A text column of an Arrow batch, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def in_slices(items: list, size_of, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about most; a larger item stands alone."""
    start = total = 0
    for i, x in enumerate(items):
        n = size_of(x)
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if items:
        yield start, len(items)


def hashed_words(raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the bytes raw, and the byte where it begins; gap: the bytes between words."""
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts = edge[::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    # bytes weigh by their place in the word: the running place, less the word's start
    place = np.arange(len(raw))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    weight = (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    value = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.where(gap, np.uint64(0), (value ^ (value >> np.uint64(31))) * weight)
    h = np.add.reduceat(mixed, starts)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xE7037ED1A0B428DB)
    return h ^ (h >> np.uint64(29)), starts
