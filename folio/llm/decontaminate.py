"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the words of a window and ignore the others. A
document holds an item if, laid over it at some place, `least` consecutive words
of the item (or the whole of a shorter item) agree in at least the share
`identity`. The masks are such that every such window holds a mask whose counting
words all agree: three spaced seeds for windows of 12 words with two replaced, and
for other lengths masks that ignore every choice of replaced words. A longer stretch
that agrees in that share as a whole counts, too, if it holds a seed.

The hashes of all windows of the items are a table, which is joined with the
hashes of the documents. A Bloom filter of the items' hashes, of bounded size,
goes to the executors first, so that only hashes that an item may have leave a
document, with the words around them; items and documents never pass the driver,
and neither the plan nor a task's memory grows with the benchmark. Around each
hit the item is laid over the document's words.

Defined cases: null texts are empty; items without a word are in no document, items
of one or few words in every document that says them; ties go to the first place;
repeated rows (equal id and text) are one document or item, equal texts of several
ids are all reported; null ids are kept; an empty benchmark finds nothing and an
empty table gives an empty table; extra columns are ignored (keep() returns them).
Words are letters, digits and underscores, compared in lower case by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, hashed_words, in_slices, materialize, sliced, texts_of

#: For 12 words of which two are replaced. 1: the word counts; 0: it is ignored.
MASKS = ("111111", "11101011", "101100111")
#: Bits of the filter: at least, for each hash, and at most (16 MB).
BITS = (1 << 20, 64, 1 << 27)
#: Hits so many words apart at most travel together.
NEAR = 256

_GAPS = re.compile(r"\W+")
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_PROBES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def replaced(n: int, identity: float) -> int:
    """How many of n words may differ."""
    return n - math.ceil(identity * n - 1e-9)


def masks(n: int, identity: float) -> tuple[str, ...]:
    """Masks of which one has all its counting words within any replaced(n, identity) of n words replaced."""
    r = min(replaced(n, identity), n - 1)
    if (n, r) == (12, 2):
        return MASKS
    classes = min(n, (1, 3, 4)[r] if r < 3 else r + 1)
    ignored = itertools.combinations(range(classes), r)
    return tuple("".join("0" if i % classes in out else "1" for i in range(n)) for out in ignored)


def plan(lengths: list[int], least: int, identity: float) -> dict[str, set[int]]:
    """The masks that items of these lengths need, each with the lengths that it is for (least: that and longer ones)."""
    found: dict[str, set[int]] = {}
    for n in sorted({min(n, least) for n in lengths if n > 0}):
        for m in masks(n, identity):
            found.setdefault(m, set()).add(n)
    return found


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one text behind the other, and where each text's words begin (with the end at last)."""
    low = [t.lower() for t in texts]
    raw = [(t if t.isascii() else _GAPS.sub(" ", t)).encode("utf-8", "surrogatepass") + b" " for t in low]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, starts = hashed_words(data, _GAP[data])
    return hashes, np.searchsorted(starts, np.cumsum([0, *map(len, raw)]))


def seeds(words: np.ndarray, of: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the hash of each window of the mask's length that lies in one text; of: each word's text."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    where = np.flatnonzero(of[:n] == of[len(mask) - 1 :])
    h = np.full(n, int(mask, 2) * 64 + len(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return where, h[where]


def _probe(hashes: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word and the bit of the k-th probe of the filter."""
    at = (hashes * _PROBES[k]) >> np.uint64(65 - bits.bit_length())
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def _filter(index: DataFrame) -> tuple[int, np.ndarray]:
    """The number of bits and the bits of a Bloom filter of index(hash), merged on the executors."""
    least, each, most = BITS
    bits = min(most, max(least, 1 << (each * index.count()).bit_length()))

    def part(batches):
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(len(_PROBES)):
                np.bitwise_or.at(own, *_probe(hashes, k, bits))
        where = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(own[where].view(np.int64))], ["at", "word"])

    # at most bits / 64 rows
    merged = index.select("hash").mapInArrow(part, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[merged.column("at").to_numpy()] = merged.column("word").to_numpy().view(np.uint64)
    return bits, out


def _keys() -> list[Column]:
    """128 bits that name a document: its id and text."""
    return [F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(7))]


def _items(benchmark: DataFrame, least: int, identity: float) -> tuple[DataFrame, DataFrame, dict[str, set[int]], int]:
    """items(item, item_id, words), index(hash, item, place), the masks in use and the longest item's words."""

    def split(batches):
        for batch in sliced(batches):
            hashes, starts = words_of(texts_of(batch, "text"))
            words = [hashes[a:b] for a, b in itertools.pairwise(starts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64())], ["item", "item_id", "words", "n"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = materialize(rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(split, "item long, item_id long, words binary, n long").where("n > 0"), "items")
    lengths = items.groupBy(F.least("n", F.lit(least)).alias("m")).agg(F.max("n").alias("n")).collect()
    used = plan([r["m"] for r in lengths], least, identity)

    def hash_all(batches):
        for batch in sliced(batches):
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words = np.frombuffer(raw, np.uint64)
                found = [seeds(words, np.zeros(len(words), np.int8), m) for m, ns in used.items() if min(len(words), least) in ns]
                places, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), item)), pa.array(places.astype(np.int32))], ["hash", "item", "place"])

    index = materialize(items.mapInArrow(hash_all, "hash long, item long, place int"), "seeds")
    return items, index, used, max((r["n"] for r in lengths), default=0)


def longest(same: np.ndarray, identity: float) -> tuple[int, int]:
    """The longest stretch of which at least the share `identity` agrees, its ends agreeing."""
    if same.all():
        return 0, len(same)
    gain = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - identity, -identity)))) + 1e-9 * np.arange(len(same) + 1)
    low, high = np.minimum.accumulate(gain), np.maximum.accumulate(gain[::-1])[::-1]
    best, i, j = (0, 0), 0, 0
    while j < len(gain) and i < len(gain):
        if low[i] <= high[j]:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    inside = np.flatnonzero(same[best[0] : best[1]])
    return (best[0] + int(inside[0]), best[0] + int(inside[-1]) + 1) if len(inside) else (0, 0)


def agreeing(doc: np.ndarray, item: np.ndarray, shift: int, least: int, identity: float) -> tuple[int, int, int] | None:
    """Agreeing words, first and end word in doc of the longest stretch, if the item laid at `shift` is held."""
    a, b, m = max(shift, 0), min(shift + len(item), len(doc)), min(least, len(item))
    if b - a < m:
        return None
    same = doc[a:b] == item[a - shift : b - shift]
    upto = np.concatenate(([0], np.cumsum(same)))
    first, end = longest(same, identity)
    if end - first < m:  # a window whose own ends are replaced
        window = upto[m:] - upto[:-m]
        if window.max() < m - replaced(m, identity):
            return None
        first = int(window.argmax())
        end = first + m
    return int(upto[end] - upto[first]), a + first, a + end


def _found(docs: DataFrame, benchmark: DataFrame, least: int, identity: float) -> tuple[DataFrame, list[DataFrame]]:
    """k1, k2, doc_id, item_id, matched, first_word, end_word: the best place of each item in each document that holds it; and the tables it reads."""
    items, index, used, reach = _items(benchmark, least, identity)
    bits, bloom = _filter(index)
    shared, span = docs.sparkSession.sparkContext.broadcast(bloom), max(map(len, used), default=0)

    def search(batches):
        """The words around the hits of each document: a row for hits of up to NEAR words."""
        known = shared.value
        for batch in sliced(batches):
            texts = texts_of(batch, "text")
            for a, b in in_slices(texts, len, 1 << 20) if used else ():
                words, starts = words_of(texts[a:b])
                of = np.repeat(np.arange(b - a), np.diff(starts))
                where, hashes = [], []
                for m in used:
                    at, h = seeds(words, of, m)
                    for k in range(len(_PROBES)):
                        word, bit = _probe(h, k, bits)
                        hit = known[word] & bit != 0
                        at, h = at[hit], h[hit]
                    where.append(at)
                    hashes.append(h)
                where, hashes = np.concatenate(where), np.concatenate(hashes)
                if not len(where):
                    continue
                order = np.argsort(where, kind="stable")
                where, hashes = where[order], hashes[order]
                group = of[where] * (len(words) + 1) + where // NEAR
                edge = np.flatnonzero(np.diff(group, prepend=-1))
                rows = []
                for i, j in itertools.pairwise([*edge.tolist(), len(where)]):
                    d = int(of[where[i]])
                    begin = max(int(where[i]) - reach, int(starts[d]))
                    end = min(int(where[j - 1]) + reach + span, int(starts[d + 1]))
                    rows.append((a + d, begin - int(starts[d]), words[begin:end].tobytes(), (where[i:j] - begin).tolist(), hashes[i:j].view(np.int64).tolist()))
                which, begins, bytes_, hits, values = zip(*rows, strict=True)
                columns = [batch.column(c).take(pa.array(which)) for c in ("k1", "k2", "doc_id")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(begins, pa.int64()), pa.array(bytes_, pa.binary()), pa.array(hits, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], ["k1", "k2", "doc_id", "begin", "words", "at", "hashes"])

    rows = docs.select(*(k.alias(f"k{i}") for i, k in enumerate(_keys(), 1)), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(search, "k1 long, k2 long, doc_id long, begin long, words binary, at array<int>, hashes array<long>")
    parts = materialize(parts.withColumn("part", F.monotonically_increasing_id()), "hits")
    hits = parts.select("part", F.explode(F.arrays_zip("at", "hashes")).alias("h")).select("part", "h.at", F.col("h.hashes").alias("hash"))
    laid = hits.join(index, "hash").select("part", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    laid = laid.join(parts.select("part", "k1", "k2", "doc_id", "begin", "words"), "part").join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")

    def verify(batches):
        for batch in sliced(batches):
            rows, which = [], []
            for i, (doc, item, shift, begin) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("words", "item_words", "shift", "begin")), strict=True)):
                got = agreeing(np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64), shift, least, identity)
                if got:
                    which.append(i)
                    rows.append((got[0], got[1] + begin, got[2] + begin))
            columns = [batch.column(c).take(pa.array(which, pa.int64())) for c in ("k1", "k2", "doc_id", "item_id")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["k1", "k2", "doc_id", "item_id", "matched", "first_word", "end_word"])

    held = laid.select("k1", "k2", "doc_id", "item_id", "begin", "words", "item_words", "shift").mapInArrow(verify, "k1 long, k2 long, doc_id long, item_id long, matched long, first_word long, end_word long")
    best = F.max(F.struct("matched", (-F.col("first_word")).alias("back"), "end_word")).alias("b")
    return held.groupBy("k1", "k2", "doc_id", "item_id").agg(best).select("k1", "k2", "doc_id", "item_id", "b.matched", (-F.col("b.back")).alias("first_word"), "b.end_word"), [items, index, parts]


def find(docs: DataFrame, benchmark: DataFrame, least: int = 12, identity: float = 0.8) -> DataFrame:
    """doc_id, item_id, matched (words), first_word, end_word: a row for each document and item that it holds."""
    return _found(docs, benchmark, least, identity)[0].drop("k1", "k2")


def keep(docs: DataFrame, benchmark: DataFrame, least: int = 12, identity: float = 0.8) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    found, read = _found(docs, benchmark, least, identity)
    held = materialize(found.select("k1", "k2").distinct(), "held")
    for table in read:
        discard(table)
    if held.count() > 200_000:  # too many to hand to every task: texts are dealt by their key, not sorted
        held = held.hint("shuffle_hash")
    k1, k2 = (k == held[c] for k, c in zip(_keys(), ("k1", "k2"), strict=True))
    return docs.join(held, k1 & k2, "left_anti")
