"""SimHash near-duplicates: exact tiled comparison of fingerprints.

Each whole text gets a fingerprint of its word shingles. Distinct fingerprints fall
into cells, and only cells meet that can hold a pair within `radius` bits: by
default the cells are the population counts of three bit ranges, whose differences
sum up to at most `radius`; for a wide radius and a least Jaccard `similarity` of the
shingles they are bands of the shingle count, of which only equal and neighbouring
ones can hold such a pair. Cells of over `tile` rows are dealt into tiles, and every
pair of tiles is compared once, whole, in blocks, by numpy exclusive-or and bit
counts; pairs of blocks whose population or shingle counts are too far apart are
skipped. A task holds one tile of a cell and the tiles that it meets, and returns a
spanning forest of the links that it finds rather than the links.

Pairs compared grow with the square of the distinct fingerprints (about 7 % of
all pairs are left at radius 3); shuffled rows are at most 32 for each
fingerprint until a cell outgrows a tile.

Defined cases: a null text is empty; texts without a word have fingerprint zero
and link like others; ties and repeated rows are copies; a null doc_id keeps its
fingerprint, links with nothing and has a null component. An empty table gives
an empty table; extra columns are ignored (dedup() returns them).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, Forest, columns_of, components, discard, join_spread, materialize, sliced, texts_of

#: Bits of each range whose population count is one coordinate of a cell.
PARTS = ((0, 22), (22, 21), (43, 21))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle of the ASCII-lower-cased text, in blocks of bounded memory."""
    import xxhash

    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    is_space = np.isin(raw, np.frombuffer(SPACES.encode(), np.uint8))
    keep = ~is_space
    keep[1:] |= ~is_space[:-1]
    body = np.where(is_space, np.uint8(32), raw)[keep]
    gap = is_space[keep]
    if len(body) and gap[0]:
        body, gap = body[1:], gap[1:]
    if len(body) and gap[-1]:
        body, gap = body[:-1], gap[:-1]
    if not len(body):
        return np.empty(0, np.uint64)
    cuts = np.flatnonzero(gap)
    starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(body)]))
    width = min(width, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    data, of = body.tobytes(), xxhash.xxh64_intdigest
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), 65536):
        s, e = starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist()
        out[at : at + len(s)] = np.fromiter((of(data[i:j], seed) for i, j in zip(s, e, strict=True)), np.uint64, len(s))
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number."""
    n = len(hashes)
    if not n:
        return 0
    starts = np.arange(0, n, 255)  # so many ones fit into a byte lane
    counts = np.empty((8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def distinct_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each distinct shingle."""
    h = (hashes ^ np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, words: int = 1) -> DataFrame:
    """doc_id, fp (the fingerprint, highest byte first) and size for each row of docs(doc_id, text).

    One word of 64 bits counts every shingle and leaves size 0; several words count
    each distinct shingle once, and size is their number.
    """

    def run(batches):
        for batch in sliced(batches):
            fps, sizes = [], []
            for t in texts_of(batch, "text"):
                hashes = shingle_hashes(t, width, seed)
                if words == 1:
                    fps.append(majority(hashes).to_bytes(8, "big"))
                    sizes.append(0)
                else:
                    once = np.unique(hashes)
                    fps.append(b"".join(majority(distinct_hashes(once, k)).to_bytes(8, "big") for k in range(words)))
                    sizes.append(len(once))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "fp", "size"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp binary, size long")


def _words(fps: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    raw = fps.to_pylist()
    return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1)


def _popcells(fps: np.ndarray) -> np.ndarray:
    counts = np.stack([np.bitwise_count((fps[:, 0] >> np.uint64(at)) & np.uint64((1 << n) - 1)) for at, n in PARTS], 1).astype(np.int64)
    return counts @ np.array([1024, 32, 1])


def _popsteps(radius: int) -> list[np.ndarray]:
    """For each way from a cell to a later one that can hold fingerprints within radius, the cell it leads to (or -1)."""
    around = itertools.product(range(-radius, radius + 1), repeat=len(PARTS))
    cells = np.stack([np.arange(32768) >> 10, (np.arange(32768) >> 5) & 31, np.arange(32768) & 31], 1)
    out = []
    for step in (d for d in around if d > (0,) * len(PARTS) and sum(map(abs, d)) <= radius):
        to = cells + np.array(step)
        out.append(np.where(((to >= 0) & (to < 32)).all(1), to @ np.array([1024, 32, 1]), -1))
    return out


#: Rows of the home tile and of its guests that are compared at once.
BLOCK = (256, 4096)


def within(fps: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows a and b (consecutive each) whose fingerprints differ in <= radius bits and whose sizes allow the similarity."""
    left, right = fps[a], fps[b]
    bits = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
    if fps.shape[1] > 1:  # most pairs are beyond the radius in two words
        bits = bits + np.bitwise_count(left[:, None, 1] ^ right[None, :, 1])
    x, y = np.nonzero(bits <= radius)
    if fps.shape[1] > 1:
        near = np.bitwise_count(left[x] ^ right[y]).sum(1, dtype=np.int64) <= radius
        x, y = x[near], y[near]
    x, y = a[x], b[y]
    if similarity:
        near = np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y]) - 1e-9
        x, y = x[near], y[near]
    return x, y


def links(classes: DataFrame, radius: int = 3, tile: int = 131072, similarity: float = 0.0) -> DataFrame:
    """A spanning forest (a, b) of the links among classes(fp, size, id): ids whose fps differ in <= radius bits.

    With a similarity, pairs whose sizes (counts of distinct shingles) rule it out are no links.
    """
    if similarity:
        slots, steps = 4096, [np.append(np.arange(1, 4096), -1)]
        band = math.log(1 / similarity)
        cells_of = lambda fps, sizes: np.where(sizes > 0, 2 + (np.log(np.maximum(sizes, 1)) / band + 1e-9).astype(np.int64), 0)
    else:
        slots, steps = 32768, _popsteps(radius)
        cells_of = lambda fps, sizes: _popcells(fps)

    def read(batch):
        return _words(batch.column("fp")), batch.column("size").to_numpy(zero_copy_only=False)

    def cell_counts(batches):
        for batch in batches:
            cells, n = np.unique(cells_of(*read(batch)) if batch.num_rows else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    counted = classes.select("fp", "size").mapInArrow(cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    tiles = np.zeros(slots, np.int64)
    for row in counted.collect():  # at most one for each slot
        tiles[row["cell"]] = -(-row["n"] // tile)
    rounds = tiles.copy()  # most tiles that a cell's own tiles meet
    reach = np.stack(steps)
    for to in reach:
        to[(to >= 0) & (tiles[to] == 0)] = -1
        np.maximum.at(rounds, to[to >= 0], tiles[np.flatnonzero(to >= 0)])

    def deal(batches):
        """Rows (unit, home, fp, size, id); unit: cell, home tile and the guests' tile."""
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = cells_of(*read(batch))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tiles[cells]

            def rows(cell, i, j, home, which):
                unit = (cell << 40) | (i << 20) | j
                kept = batch.take(pa.array(which))
                return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(np.full(len(unit), home)), *(kept.column(c) for c in ("fp", "size", "id"))], ["unit", "home", "fp", "size", "id"])

            for j in range(int(rounds[cells].max(initial=0))):
                which = np.flatnonzero(rounds[cells] > j)
                yield rows(cells[which], own[which], j, True, which)
            for i in range(int(own.max(initial=0))):  # a tile is a guest of its cell's earlier tiles
                which = np.flatnonzero(own > i)
                yield rows(cells[which], i, own[which], False, which)
            for k in range(len(reach)):
                to = reach[k, cells]
                for i in range(int(np.where(to >= 0, tiles[to], 0).max(initial=0))):
                    which = np.flatnonzero((to >= 0) & (tiles[to] > i))
                    yield rows(to[which], i, own[which], False, which)

    def compare(unit: pa.Table) -> pa.Table:
        fps, sizes = _words(unit.column("fp")), unit.column("size").to_numpy()
        ids, home = unit.column("id").to_numpy(), unit.column("home").to_numpy(zero_copy_only=False).astype(bool)
        bits = np.bitwise_count(fps).sum(1, dtype=np.int64)
        order = np.lexsort((bits, sizes, ~home))
        fps, ids, sizes, bits, n = fps[order], ids[order], sizes[order], bits[order], int(home.sum())
        forest = Forest(len(fps))
        key = int(unit.column("unit")[0].as_py())
        inside = (key >> 20) & 0xFFFFF == key & 0xFFFFF  # then the home tile meets itself, too
        for at in range(0, n, BLOCK[0]):
            a = np.arange(at, min(n, at + BLOCK[0]))
            for start in (*range(at // BLOCK[1] * BLOCK[1] if inside else n, n, BLOCK[1]), *range(n, len(fps), BLOCK[1])):
                b = np.arange(start, min(n if start < n else len(fps), start + BLOCK[1]))
                if max(bits[a].min(), bits[b].min()) - min(bits[a].max(), bits[b].max()) > radius:
                    continue
                if similarity and max(sizes[a[0]], sizes[b[0]]) * similarity > min(sizes[a[-1]], sizes[b[-1]]) + 1e-9:
                    continue
                x, y = within(fps, sizes, a, b, radius, similarity)
                new = forest.parent[x] != forest.parent[y]
                if new.any():
                    forest.add(x[new], y[new])
        linked = np.flatnonzero(forest.parent != np.arange(len(fps)))
        return pa.table({"a": ids[linked], "b": ids[forest.parent[linked]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    dealt = classes.select("fp", "size", "id").mapInArrow(deal, "unit long, home boolean, fp binary, size long, id long")
    return dealt.groupBy("unit").applyInArrow(compare, "a long, b long")


def group(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3, tile: int = 131072, words: int = 1, similarity: float = 0.0) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, for each row of docs."""
    fps = materialize(fingerprints(docs, width, seed, words), "fingerprints")
    classes = materialize(fps.where("doc_id IS NOT NULL").groupBy("fp", "size").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    found = components(links(classes, radius, tile, similarity))
    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", "size", F.coalesce("root", "id").alias("component_id"), "copies")
    joined = join_spread(fps, materialize(named, "named"), ["fp", "size"], "copies")
    discard(classes)
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, **rules) -> DataFrame:
    """The row of least doc_id of each group of docs, and rows without a doc_id.

    Rows of an equal doc_id are one document, of which the least row (as JSON) stays.
    """
    kept = group(docs, **rules).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = materialize(kept, "kept")
    # ids are hashed, so that the texts are shuffled once and never sorted
    once = docs.join(kept.where("n = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(*columns_of(docs))
    out = once.union(docs.where("doc_id IS NULL"))
    repeated = kept.where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    row = F.struct(*columns_of(docs))
    # by JSON, because maps have no order
    least = docs.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), row.alias("row")).groupBy("id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.union(least.select("row.*"))


#: Of near copies: five words, 256 bits, and the bits that texts of Jaccard similarity 0.8 differ in, with a margin.
NEAR = {"width": 5, "words": 4, "radius": 46, "similarity": 0.8}


def hexed(fp: Column | str) -> Column:
    return F.lower(F.hex(fp))
