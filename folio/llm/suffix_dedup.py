"""Suffix-array deduplication with sparse suffixes.

Only suffixes at content-selected positions are retained: of every `window`
consecutive hashes of `k` words, the least (a minimiser). Any passage of `least`
words holds such a position, the same in every document, as window + k - 1 is
`least`. Positions whose k words occur in one document only are dropped after a
pre-aggregated count. The others are sorted by the words that follow, over the
whole cluster. Suffixes with the same first k words form a run, within which every
stretch of `least` words around those words, to the right and to the left, is
compared with those of all other documents by a 64-bit hash. Stretches that
another document holds are joined into each document's repeated passages.

The sort is by range, so a passage that a third of all documents hold spreads
over many tasks. The first and the last run of a task may go on in another, and a
run of over RUN rows isn't held whole: their stretches whose right part also stands
at the border meet in a second pass, dealt by hash, to which a task hands at most
two rows for a stretch that several of its documents hold.

Defined cases: a null text is empty; ties (equal suffixes) order by document;
repeated rows (equal doc_id) are one document and never each other's repeat; a
null doc_id is left out; an empty table gives an empty table; extra columns are
ignored. Words are separated by white space and compared by 31-bit hashes; as 50
of them must agree, unequal stretches that pass for equal are not to be expected.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, hashed_words, join_spread, materialize, sliced, texts_of

#: A run of so many suffixes is not held whole; its stretches meet by their hash.
RUN = 16384

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word of the text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return hashed_words(raw, _SPACE[raw])[0]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return h


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least of some full window (all of equal least ones)."""
    n = len(hashes)
    if n < window:
        return np.empty(0, np.int64)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = hashes
    rows = padded.reshape(-1, window)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[: n - window + 1], before[window - 1 : n])  # of the window from each position
    # a position is selected if it equals the least of a window that holds it: the largest of those windows' least values
    full = np.zeros(n + 2 * (window - 1), np.uint64)
    full[window - 1 : window - 1 + len(least)] = least
    top = np.zeros(-(-len(full) // window) * window, np.uint64)
    top[: len(full)] = full
    rows = top.reshape(-1, window)
    before = np.maximum.accumulate(rows, 1).ravel()
    after = np.maximum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    highest = np.maximum(after[:n], before[window - 1 : window - 1 + n])
    return np.flatnonzero(hashes == highest)


def _windows(table: pa.Table, least: int, reach: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, begin and hash of each stretch of `least` words in the text that holds the first k words of a row's suffix.

    begin counts from the suffix's position, at most 0. Equal stretches around equal words have equal hashes.
    """
    n = table.num_rows
    right, left = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32).reshape(n, reach) for c in ("right", "left"))
    words = np.concatenate((left[:, least - k - 1 :: -1] if least > k else left[:, :0], right[:, :least]), 1)
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.random.default_rng(7).integers(0, 1 << 64, words.shape[1], np.uint64) | np.uint64(1)
    upto = np.zeros((n, words.shape[1] + 1), np.uint64)
    np.cumsum(mixed, 1, out=upto[:, 1:])
    row, at = np.nonzero((words[:, : least - k + 1] != 0) & (words[:, least - 1 :] != 0))  # 0: beyond the text
    return row, at - (least - k), upto[row, at + least] - upto[row, at]


def _grouped(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group of each row by its hash, and each group's hash and least and greatest document."""
    if not len(hashes):
        return np.empty(0, np.int64), hashes, docs, docs
    order = np.argsort(hashes)
    h, d = hashes[order], docs[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    starts = np.flatnonzero(first)
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(first) - 1
    return of, h[starts], np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)


def _slices(first: list, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of whole runs of equal keys, of 4,096 rows or the run that goes beyond."""
    while start < stop:
        end = min(stop, bisect.bisect_right(first, first[min(stop, start + 4096) - 1]))
        yield start, end
        start = end


def _compare(table: pa.Table, least: int, reach: int, k: int, whole: bool) -> pa.Table:
    """Spans that documents of the table repeat; unless its runs are whole, also what stretches have to meet elsewhere.

    A stretch of one document goes on as a row with its place, one of several as two
    documents that hold it, so a common stretch leaves two rows however often it stands.
    """
    doc, pos = table.column("doc_id").to_numpy(), table.column("pos").to_numpy().astype(np.int64)
    row, begin, h = _windows(table, least, reach, k)
    of, distinct, low, high = _grouped(h, doc[row])
    common = low != high
    found = np.flatnonzero(common[of])
    # rows come in order and a row's stretches by their begin; all hold its first word, so they join into one
    edge = np.flatnonzero(np.diff(row[found], prepend=-1))
    ends = np.append(edge[1:], len(found)) - 1 if len(edge) else edge
    at = row[found[edge]]
    columns = [doc[at], pos[at] + begin[found[edge]], pos[at] + begin[found[ends]] + least]
    spans = pa.table([*columns, pa.nulls(len(at), pa.int64())], schema=_OUT)
    if whole:
        return spans
    # rows are sorted: a right part that differs from the table's first and last row's stands in this table only
    right = np.frombuffer(b"".join(table.column("right").to_pylist()), np.uint32).reshape(-1, reach)
    same = [np.where((eq := right == right[i]).all(1), reach, eq.argmin(1)) for i in (0, -1)]
    unsettled = begin + least <= np.maximum(*same)[row]
    alone = np.flatnonzero(~common[of] & unsettled)
    common = common & (np.bincount(of[unsettled], minlength=len(common)) > 0)
    start = pos[row[alone]] + begin[alone]
    waiting = pa.table([doc[row[alone]], start, start + least, h[alone].view(np.int64)], schema=_OUT)
    n = 2 * int(common.sum())
    holders = [np.concatenate((low[common], high[common])), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), np.tile(distinct[common], 2).view(np.int64)]
    return pa.concat_tables([spans, waiting, pa.table(holders, schema=_OUT)])


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64())])


def repeats(docs: DataFrame, least: int = 50, k: int = 8) -> DataFrame:
    """doc_id, start, end: each maximal stretch of words (end exclusive) of docs(doc_id, text) that another document repeats."""
    window, reach = least - k + 1, least
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")

    def select(batches):
        for batch in sliced(batches):
            ids, positions, values, n = batch.column("doc_id").to_numpy(zero_copy_only=False), [], [], []
            for t in texts_of(batch, "text"):
                h = grams(word_hashes(t), k)
                at = minimisers(h, window)
                positions.append(at)
                values.append(h[at])
                n.append(len(at))
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(positions).astype(np.int32)), pa.array(np.concatenate(values).view(np.int64))], ["doc_id", "pos", "gram"])

    selected = materialize(texts.mapInArrow(select, "doc_id long, pos int, gram long"), "minimisers")
    spread = selected.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("copies")).where("a <> b").select("gram", "copies")
    shared = join_spread(selected, materialize(spread, "shared"), ["gram"], "copies", "inner")
    places = shared.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("at"))

    def cut(batches):
        """The words around each kept position: `reach` of 32-bit hashes to the right, and to the left going backwards."""
        for batch in sliced(batches):
            for d, t, at in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), batch.column("at").to_pylist(), strict=True):
                words = (word_hashes(t) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                padded = np.concatenate((np.zeros(reach, np.uint32), words, np.zeros(reach, np.uint32)))
                p = np.array(at, np.int64)
                p = p[p < len(words)]
                for i in range(0, len(p), 4096):
                    q = p[i : i + 4096]
                    right, left = padded[q[:, None] + reach + np.arange(reach)], padded[q[:, None] + reach - 1 - np.arange(reach)]
                    columns = [pa.array([d] * len(q), pa.int64()), pa.array(q.astype(np.int32)), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (right, left))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pos", "right", "left"])

    suffixes = materialize(texts.join(places, "doc_id").mapInArrow(cut, "doc_id long, pos int, right binary, left binary"), "suffixes")
    order = ("right", "left", "doc_id", "pos")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def compare(batches):
        """Compare whole runs of suffixes with equal first k words; a task's first and last run and very long ones stay open."""
        held, opened = None, True  # opened: the first run held has rows elsewhere
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                more = pa.Table.from_batches([batch])
                held = more if held is None else pa.concat_tables([held, more])
            if held is None or (batch is not None and held.num_rows < 4096):
                continue
            first = [r[: 4 * k] for r in held.column("right").to_pylist()]
            last = bisect.bisect_left(first, first[-1])  # the last run begins here
            at = 0
            if opened and last:
                at = bisect.bisect_right(first, first[0])
                yield from _open(held.slice(0, at))
                opened = False
            for i, j in _slices(first, at, last):
                yield from _compare(held.slice(i, j - i), least, reach, k, True).to_batches(65536)
            held = held.slice(last)
            if batch is None or opened or held.num_rows >= RUN:
                yield from _open(held)
                held, opened = None, True

    def _open(table):
        for i in range(0, table.num_rows, RUN):
            yield from _compare(table.slice(i, RUN), least, reach, k, False).to_batches(65536)

    found = materialize(sorted_.mapInArrow(compare, "doc_id long, start long, end long, hash long"), "spans")
    # stretches of open runs meet by their hash
    waiting = found.where("hash IS NOT NULL")
    common = waiting.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("hash")
    met = waiting.where("start IS NOT NULL").join(materialize(common, "met"), "hash").select("doc_id", "start", "end")
    spans = found.where("hash IS NULL").select("doc_id", "start", "end").union(met)

    def join(batches):
        for batch in batches:
            rows = []
            for d, xs in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                begin, stop = xs[0]["start"], xs[0]["end"]
                for x in xs[1:]:
                    if x["start"] > stop:
                        rows.append((d, begin, stop))
                        begin, stop = x["start"], x["end"]
                    stop = max(stop, x["end"])
                rows.append((d, begin, stop))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 3)], ["doc_id", "start", "end"])

    per_doc = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return per_doc.mapInArrow(join, "doc_id long, start long, end long")
