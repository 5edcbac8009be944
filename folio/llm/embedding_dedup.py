"""Embedding near-duplicates by spherical k-means cells and blocked cosine products.

Centroids are fitted on the driver from a bounded sample. Every vector goes to
the cell of its nearest centroid. Two vectors of cosine >= t lie at most
sqrt(2 - 2t) apart, so a vector that links across the border of two cells lies
within that distance of the plane between their centroids; only such vectors
meet the other cell, and no link is lost. Cells of over `tile` rows are dealt
into tiles. A task holds one pair of tiles, multiplies them in blocks (single
precision to rule out, double precision to decide), and returns for each linked
vector its count and its root in a spanning forest, never the pairs. Equal
vectors are one class that counts its copies. One representative, the smallest
id, stays of each group.

Pruning depends on the vectors: clustered ones meet few other cells; directions
spread evenly over many dimensions meet nearly all, and then all pairs are
multiplied and each row is shuffled once for each cell.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component link with nothing and are their own component; so are vectors without
an id, whose component is null. Vectors of different lengths never link. Rows of
an equal id are one vector, the least of them. Ties and repeated rows count as
copies only under different ids. An empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Forest, components, join_spread, materialize

#: At most so many vectors are learned from, for this many rows a cell.
SAMPLE, CELL = 16384, 4096
CELLS = (24, 1024)


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centroids of unit rows, by Lloyd's steps from the first k rows."""
    centres = unit[: min(k, len(unit))].copy()
    for _ in range(rounds):
        home = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _units(flat: pa.Array | np.ndarray, width: int) -> np.ndarray:
    rows = np.asarray(flat, np.float64).reshape(-1, width)
    rows = rows / np.maximum(np.abs(rows).max(1, keepdims=True), 1e-300)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _links(classes: DataFrame, width: int, threshold: float, tile: int) -> DataFrame:
    """id, n, root: for classes(id, copies, embedding) of one length, a row for each task in which a class has links."""
    total = classes.count()
    k = min(max(CELLS[0], -(-total // CELL)), CELLS[1])
    sample = classes.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    centres = spherical_kmeans(_units(sample.column("embedding").combine_chunks().flatten(), width), k)
    k = len(centres)
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    reach = np.sqrt(2 - 2 * threshold) + 1e-9

    def homes(batches):
        for batch in batches:
            home, n = np.unique((_units(batch.column("embedding").flatten(), width) @ centres.T).argmax(1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(n)], ["cell", "n"])

    tiles = np.ones(k, np.int64)
    for r in classes.select("embedding").mapInArrow(homes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        tiles[r["cell"]] = -(-r["n"] // tile)

    def deal(batches):
        """A row for each unit, which is (first cell, second cell, tile of the first, tile of the second)."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = _units(part.column("embedding").flatten(), width) @ centres.T
                ids = part.column("id").to_numpy()
                home = near.argmax(1)
                own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tiles[home]
                gap = near[np.arange(len(home)), home][:, None] - near
                meets = gap <= reach * apart[home] + 1e-9
                meets[np.arange(len(home)), home] = True
                row, cell = np.nonzero(meets)
                n = tiles[cell]  # tiles of the other cell; within a cell each pair of tiles meets once
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                a, b, i, j = home[row], cell, own[row], other
                swap = (a > b) | ((a == b) & (i > j))
                a, b, i, j = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, j, i), np.where(swap, i, j)
                unit = (a << 50) | (b << 40) | (i << 20) | j
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(~swap), *(part.column(c).take(pa.array(row)) for c in ("id", "copies", "embedding"))], ["unit", "first", "id", "copies", "embedding"])

    def compare(unit: pa.Table) -> pa.Table:
        key = unit.column("unit")[0].as_py()
        vectors = _units(unit.column("embedding").combine_chunks().flatten(), width)
        ids, copies = unit.column("id").to_numpy(), unit.column("copies").to_numpy()
        first = unit.column("first").to_numpy(zero_copy_only=False).astype(bool)
        inside = key >> 50 == key >> 40 & 0x3FF and key >> 20 & 0xFFFFF == key & 0xFFFFF
        one, two = (np.arange(len(ids)),) * 2 if inside else (np.flatnonzero(first), np.flatnonzero(~first))
        if not len(one) or not len(two):
            return _NONE
        small, forest, n = vectors.astype(np.float32), Forest(len(ids)), np.zeros(len(ids), np.int64)
        for at in range(0, len(one), 512):
            rows = one[at : at + 512]
            maybe = small[rows] @ small[two].T >= threshold - 1e-4
            if maybe.sum() > maybe.size // 50:
                a, b = np.nonzero(maybe & (vectors[rows] @ vectors[two].T >= threshold))
            else:
                a, b = np.nonzero(maybe)
                sure = np.einsum("ij,ij->i", vectors[rows[a]], vectors[two[b]]) >= threshold
                a, b = a[sure], b[sure]
            a, b = rows[a], two[b]
            apart_ = a != b
            a, b = a[apart_], b[apart_]
            np.add.at(n, a, copies[b])
            if not inside:
                np.add.at(n, b, copies[a])
            forest.add(a, b)
        linked = np.flatnonzero(n)
        return pa.table({"id": ids[linked], "n": n[linked], "root": ids[forest.parent[linked]]}, schema=_NONE.schema)

    dealt = classes.mapInArrow(deal, "unit long, first boolean, id long, copies long, embedding " + _kind(classes))
    return dealt.groupBy("unit").applyInArrow(compare, "id long, n long, root long")


_NONE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]).empty_table()


def _kind(vectors: DataFrame) -> str:
    """Vectors of floats stay so in shuffles; they are multiplied as doubles."""
    kind = dict(vectors.dtypes)["embedding"]
    return kind if kind == "array<float>" else "array<double>"


def group(vectors: DataFrame, threshold: float = 0.9, tile: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector of vectors(vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(_kind(vectors)))
    single = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).union(rows.where("vec_id IS NULL"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    single = materialize(single.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    classes = materialize(single.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    widths = sorted(r["w"] for r in classes.select(F.size("embedding").alias("w")).distinct().collect())
    counted = None
    for w in widths:
        part = _links(classes.where(F.size("embedding") == w).select("id", "copies", "embedding"), w, threshold, tile)
        counted = part if counted is None else counted.union(part)
    if counted is None:
        named = classes.select("embedding", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), "copies")
    else:
        counted = materialize(counted, "links")
        found = components(counted.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
        sums = counted.groupBy("id").agg(F.sum("n").alias("n"))
        named = classes.join(sums, "id", "left").join(found, "id", "left").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"), "copies")
    usable_rows = join_spread(single.where("usable"), materialize(named, "named"), ["embedding"], "copies", "inner").select("vec_id", "n_links", "component_id")
    others = single.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable_rows.union(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
