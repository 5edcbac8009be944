"""The content store: chunks, manifests, reference counts, release, collection and restore."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.plans.components import materialize

# Fixed values of the chunk format: they decide where contents are cut.
MIN_CHUNK, TARGET_CHUNK, MAX_CHUNK = 256 << 10, 1 << 20, 4 << 20
STRICT_BITS, LAX_BITS = 22, 18
GEAR_SEED = 0x9E3779B97F4A7C15
GEAR_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def gear_table() -> np.ndarray:
    """The substitution table: 256 outputs of the splitmix64 generator, from its second step on."""
    with np.errstate(over="ignore"):
        z = np.uint64(GEAR_SEED) * np.arange(2, 258, dtype=np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(GEAR_MULTIPLIERS[0])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(GEAR_MULTIPLIERS[1])
        return z ^ (z >> np.uint64(31))


_GEAR = gear_table()


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte. Only the last 64 bytes count, so six doublings give it."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16, 32):
        h[width:] += h[:-width] << np.uint64(width)  # the right side is made before the sum
    return h


def cut_points(data: bytes, least: int = MIN_CHUNK, target: int = TARGET_CHUNK, most: int = MAX_CHUNK, strict: int = STRICT_BITS, lax: int = LAX_BITS) -> list[int]:
    """Where each chunk of data ends."""
    raw, cuts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        piece = raw[at : at + most]
        end = len(piece)
        if end > least:
            h = rolling(piece[least:])
            turn = max(0, min(target, end) - least)
            hit = np.flatnonzero(h[:turn] >> np.uint64(64 - strict) == 0)
            if len(hit):
                end = least + int(hit[0])
            elif len(hit := np.flatnonzero(h[turn:] >> np.uint64(64 - lax) == 0)):
                end = least + turn + int(hit[0])
        at += end
        cuts.append(at)
    return cuts


def chunked(contents: DataFrame, once: bool = False, **bounds) -> DataFrame:
    """file_hash, idx, chunk_hash, size, content for each chunk of contents(content BINARY, ...); a chunk is emitted as it is cut.

    With once, a task cuts equal contents only the first time; other tasks may cut them again.
    """

    def run(batches):
        cut = set()
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py() or b""
                whole, start = hashlib.sha256(data).hexdigest(), 0
                if once and whole in cut:
                    continue
                cut.add(whole)
                for idx, end in enumerate(cut_points(data, **bounds)):
                    piece = data[start:end]
                    yield pa.RecordBatch.from_arrays([pa.array([whole]), pa.array([idx], pa.int32()), pa.array([hashlib.sha256(piece).hexdigest()]), pa.array([len(piece)], pa.int64()), pa.array([piece], pa.binary())], ["file_hash", "idx", "chunk_hash", "size", "content"])
                    start = end

    return contents.select("content").mapInArrow(run, "file_hash string, idx int, chunk_hash string, size long, content binary")


def store(contents: DataFrame, files: DataFrame, chunks: DataFrame, file_chunks: DataFrame, known: DataFrame, **bounds) -> dict[str, DataFrame]:
    """Each row of contents(content) stored once more: the new files, chunks, file_chunks and the chunk_data to append.

    A file that is known only counts one reference more. A new file counts its
    chunks, each as often as it occurs. Null contents aren't stored. Give contents
    as a written table: it is read for the hashes and, without what is known, for
    the chunks. The chunks are written before they are counted, so each content is
    cut in one pass, and no whole content is shuffled but to drop the known ones.
    """
    hashed = contents.where("content IS NOT NULL").select("content", F.sha2("content", 256).alias("hash"))
    counts = hashed.select("hash", F.octet_length("content").cast("long").alias("size")).groupBy("hash").agg(F.min("size").alias("size"), F.count("*").alias("refcount"))
    fresh = hashed.join(files.select("hash"), "hash", "left_anti")
    pieces = materialize(chunked(fresh, once=True, **bounds), "pieces")
    places = pieces.select("file_hash", "idx", "chunk_hash", "size").distinct()
    used = places.groupBy(F.col("chunk_hash").alias("hash")).agg(F.min("size").alias("size"), F.count("*").alias("refcount"))
    data = pieces.groupBy(F.col("chunk_hash").alias("hash")).agg(F.first("content").alias("content")).join(known.select("hash"), "hash", "left_anti")
    return {"files": add_counts(files, counts), "chunks": add_counts(chunks, used), "file_chunks": file_chunks.unionByName(places.select("file_hash", "idx", "chunk_hash")), "chunk_data": data}


def add_counts(table: DataFrame, more: DataFrame) -> DataFrame:
    """table(hash, size, refcount) with the counts of more added."""
    return table.unionByName(more).groupBy("hash").agg(F.min("size").alias("size"), F.sum("refcount").alias("refcount"))


def exists(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of hashes(hash) whose file is stored."""
    return hashes.join(files.select("hash"), "hash", "left_semi")


def chunk_refcounts(file_chunks: DataFrame) -> DataFrame:
    return file_chunks.groupBy(F.col("chunk_hash").alias("hash")).agg(F.count("*").alias("refcount"))


def wrong_refcounts(chunks: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """Chunks whose count isn't the number of their places in manifests: hash, recorded, counted."""
    counted = chunk_refcounts(file_chunks).withColumnRenamed("refcount", "counted")
    both = chunks.select("hash", F.col("refcount").alias("recorded")).join(counted, "hash", "full")
    return both.withColumns({"recorded": F.coalesce("recorded", F.lit(0)), "counted": F.coalesce("counted", F.lit(0))}).where("recorded <> counted")


def file_refcounts(log: DataFrame) -> DataFrame:
    """hash, refcount from log(hash, delta): +1 for a store, -1 for a release."""
    return log.groupBy("hash").agg(F.sum("delta").alias("refcount"))


def release(files: DataFrame, chunks: DataFrame, file_chunks: DataFrame, hashes: DataFrame) -> dict[str, DataFrame]:
    """One reference less for each row of hashes(hash); a file without references goes, and its chunks count less by its uses."""
    dropped = hashes.groupBy("hash").agg(F.count("*").alias("_n"))
    left = files.join(dropped, "hash", "left").withColumn("refcount", F.col("refcount") - F.coalesce("_n", F.lit(0))).drop("_n")
    gone = left.where("refcount <= 0").select(F.col("hash").alias("file_hash"))
    fewer = file_chunks.join(gone, "file_hash", "left_semi").groupBy(F.col("chunk_hash").alias("hash")).agg(F.count("*").alias("_n"))
    kept = chunks.join(fewer, "hash", "left").withColumn("refcount", F.col("refcount") - F.coalesce("_n", F.lit(0))).select(*chunks.columns)
    return {"files": left.where("refcount > 0").select(*files.columns), "chunks": kept, "file_chunks": file_chunks.join(gone, "file_hash", "left_anti").select(*file_chunks.columns)}


def garbage(chunks: DataFrame) -> DataFrame:
    return chunks.where("refcount = 0")


def orphans(on_disk: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blobs that no chunk row names: on_disk(hash, size)."""
    return on_disk.join(chunks.select("hash"), "hash", "left_anti")


def collect_garbage(chunks: DataFrame, on_disk: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks that stay, hashes whose blobs go, and one row of statistics."""
    doomed = garbage(chunks).select("hash", "size")
    if on_disk is not None:
        doomed = doomed.union(orphans(on_disk, chunks).select("hash", "size"))
    return chunks.where("refcount > 0"), doomed.select("hash"), gc_stats(doomed)


def gc_stats(doomed: DataFrame) -> DataFrame:
    return doomed.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def restored_pieces(file_chunks: DataFrame, chunk_data: DataFrame, hashes: DataFrame) -> DataFrame:
    """hash, idx, content, whole for the chunks of hashes(hash): whole is false where a chunk is missing or isn't what its name says."""
    proven = chunk_data.select(F.col("hash").alias("chunk_hash"), "content", (F.sha2("content", 256) == F.col("hash")).alias("whole"))
    asked = file_chunks.withColumnRenamed("file_hash", "hash").join(hashes.select("hash"), "hash", "left_semi")
    return asked.join(proven, "chunk_hash", "left").select("hash", "idx", "content", F.coalesce("whole", F.lit(False)).alias("whole"))


def put_together(pieces: DataFrame, *more: Column) -> DataFrame:
    """hash, content and more for the chunks of each hash, in order; a content must fit into one row (2 GB)."""
    return pieces.groupBy("hash").agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY idx)").alias("content"), *more)


def restore(files: DataFrame, file_chunks: DataFrame, chunk_data: DataFrame, hashes: DataFrame) -> DataFrame:
    """hash, state ("ok", "missing", "corrupt") and content for each row of hashes(hash); content only where all chunks prove whole.

    A content becomes one row; larger ones can be written piece by piece from restored_pieces().
    """
    wanted = hashes.join(files.select("hash", F.lit(True).alias("_known")), "hash", "left")
    joined = put_together(restored_pieces(file_chunks, chunk_data, hashes), F.min("whole").alias("_whole"))
    state = F.when(F.col("_known").isNull(), "missing").when(F.coalesce("_whole", F.lit(True)), "ok").otherwise("corrupt")
    return wanted.join(joined, "hash", "left").select("hash", state.alias("state"), F.when(state == "ok", F.coalesce("content", F.lit(b"").cast("binary"))).alias("content"))


def exportable(versions: DataFrame, ids: DataFrame) -> DataFrame:
    """Versions of ids(id) and whether their content can be exported."""
    return versions.join(ids, "id", "left_semi").select("id", "file_hash", "file_key", "observed_at", F.col("content_present").alias("exportable"))


def opening(versions: DataFrame, observed: DataFrame) -> DataFrame:
    """How each version opens: "live" if its file still holds it, else a "copy", or "gone"."""
    live = observed.select(F.col("path").alias("file_key"), F.col("last_hash"))
    how = F.when(F.col("last_hash") == F.col("file_hash"), "live").when(F.col("content_present"), "copy").otherwise("gone")
    return versions.join(live, "file_key", "left").select("id", how.alias("opens"))
