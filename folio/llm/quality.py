"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over all bytes of a text. Each filter is max-pooled over
overlapping chunks that cover the whole text; a chunk's pooled values, averaged
over the chunks and at their largest and smallest, go through a small layer into
one probability. The network is fitted on the driver from a bounded sample of
labelled texts and scored where the texts are, in one pass without a shuffle.

Defined cases: a null or empty text scores as one chunk without bytes; ties and
repeated rows score alike; a null doc_id is kept; without labels of both classes
every score is the labels' rate (0.5 without any); an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._labelled import Adam, sample
from ._shared import fold, in_slices, sliced, texts_of

#: Positions of a block; a chunk is SPAN blocks, and the next begins STEP blocks further.
BLOCK, SPAN, STEP = 128, 4, 3
WIDTH, FILTERS, EMBED, HIDDEN = 6, 16, 8, 16
#: At most so many documents of a class are learned from.
EACH = 1500


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text padded with zeros to whole blocks, and each text's number of blocks.

    A block of zeros follows each text and belongs to none, so that no filter sees the next text.
    """
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    out = np.zeros(int((blocks + 1).sum()) * BLOCK + WIDTH, np.uint8)
    at = 0
    for t, n in zip(texts, blocks.tolist(), strict=True):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += (n + 1) * BLOCK
    return out, blocks


def _chunks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block (exclusive) of each chunk, and each text's first chunk."""
    first = np.concatenate(([0], np.cumsum(blocks + 1)[:-1]))
    n = np.maximum(1, -(-(blocks - SPAN) // STEP) + 1)
    of = np.repeat(np.arange(len(blocks)), n)
    offset = np.concatenate(([0], np.cumsum(n)[:-1]))
    start = first[of] + STEP * (np.arange(len(of)) - offset[of])
    return start, np.minimum(start + SPAN, first[of] + blocks[of]), offset


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.5, (256, EMBED)), "filters": r.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), "bias": np.zeros(FILTERS),
            "hidden": r.normal(0, 0.15, (3 * FILTERS, HIDDEN)), "hidden_bias": np.zeros(HIDDEN), "out": r.normal(0, 0.3, HIDDEN), "out_bias": np.zeros(1),
        }
        self.shift, self.constant = 0.0, None

    def table(self) -> np.ndarray:
        """What each byte at each place adds to each filter."""
        return np.einsum("bd,wdf->wbf", self.w["embed"], self.w["filters"]).astype(np.float32)

    def pooled(self, data: np.ndarray, table: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest value in each block, and its place."""
        n = (len(data) - WIDTH) // BLOCK
        top, place = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
        each = 256
        for a in range(0, n, each):
            b = min(n, a + each)
            part = data[a * BLOCK : b * BLOCK + WIDTH]
            size = (b - a) * BLOCK
            got = table[0].take(part[:size], 0)
            for k in range(1, WIDTH):
                got += table[k].take(part[k : k + size], 0)
            got = got.reshape(b - a, BLOCK, FILTERS)
            top[a:b] = got.max(1)
            if where:
                place[a:b] = got.argmax(1) + (np.arange(a, b) * BLOCK)[:, None]
        return top, place

    def forward(self, data: np.ndarray, blocks: np.ndarray, table: np.ndarray, where: bool = False) -> dict:
        top, place = self.pooled(data, table, where)
        start, end, offset = _chunks(blocks)
        chunk = np.maximum.reduceat(top, np.stack([start, end], 1).ravel(), 0)[::2]
        z = chunk + self.w["bias"]
        a = np.maximum(z, 0)
        n = np.diff(np.append(offset, len(start)))[:, None]
        x = np.concatenate([np.add.reduceat(a, offset, 0) / n, np.maximum.reduceat(a, offset, 0), np.minimum.reduceat(a, offset, 0)], 1)
        h = np.maximum(x @ self.w["hidden"] + self.w["hidden_bias"], 0)
        return {"logit": h @ self.w["out"] + self.w["out_bias"][0], "h": h, "x": x, "a": a, "z": z, "top": top, "place": place, "start": start, "end": end, "offset": offset, "n": n}

    def gradients(self, data: np.ndarray, blocks: np.ndarray, y: np.ndarray) -> dict:
        t = self.forward(data, blocks, self.table(), True)
        d = (1 / (1 + np.exp(-t["logit"])) - y) / len(y)
        g = {"out": t["h"].T @ d, "out_bias": np.array([d.sum()])}
        dh = np.outer(d, self.w["out"]) * (t["h"] > 0)
        g |= {"hidden": t["x"].T @ dh, "hidden_bias": dh.sum(0)}
        dx = dh @ self.w["hidden"].T
        of = np.repeat(np.arange(len(y)), t["n"][:, 0])
        mean, high, low = (dx[:, k * FILTERS : (k + 1) * FILTERS][of] for k in range(3))
        x = t["x"][of]
        share = lambda hit: hit / np.add.reduceat(hit.astype(np.int64), t["offset"], 0)[of]  # noqa: E731  equal chunks share the gradient
        da = mean / t["n"][of] + high * share(t["a"] == x[:, FILTERS : 2 * FILTERS]) + low * share(t["a"] == x[:, 2 * FILTERS :])
        da *= t["z"] > 0
        g["bias"] = da.sum(0)
        # back to the place of each chunk's largest value
        chunk, f = np.nonzero(da)
        best = t["start"][chunk].copy()
        for k in range(1, SPAN):
            other = np.minimum(t["start"][chunk] + k, t["end"][chunk] - 1)
            best = np.where(t["top"][other, f] > t["top"][best, f], other, best)
        at, amount = t["place"][best, f], da[chunk, f]
        dt = np.zeros((WIDTH, 256, FILTERS))
        for k in range(WIDTH):
            np.add.at(dt[k], (data[at + k], f), amount)
        g["filters"] = np.einsum("bd,wbf->wdf", self.w["embed"], dt)
        g["embed"] = np.einsum("wbf,wdf->bd", dt, self.w["filters"])
        return g

    def score(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        table = self.table()
        for a, b in in_slices(texts, len, 1 << 20):
            if self.constant is not None:
                yield np.full(b - a, self.constant)
                continue
            logit = self.forward(*_laid(texts[a:b]), table)["logit"] + self.shift
            yield 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit(texts: list[str], y: list[int], rate: float, steps: int = 500, batch: int = 32, seed: int = 0) -> Network:
    """Adam over batches that hold both classes in equal number; the scores are shifted back to the rate."""
    net = Network(seed)
    data, y_ = [(t or "").encode("utf-8", "surrogatepass") for t in texts], np.array(y)
    classes = [np.flatnonzero(y_ == k) for k in (0, 1)]
    if not len(classes[0]) or not len(classes[1]):
        net.constant = rate
        return net
    r, adam = np.random.default_rng(seed), Adam(net.w, 0.01)
    for step in range(steps):
        if step == steps * 2 // 3:
            adam.rate = 0.003
        at = np.concatenate([r.choice(c, batch // 2) for c in classes])
        adam.step(net.gradients(*_laid([data[i] for i in at]), y_[at]))
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    net.shift = float(np.log(rate / (1 - rate)))
    return net


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, left_out: int = 0, each: int = EACH) -> Network:
    return fit(*sample(docs, labels, "quality", folds, left_out, each))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score, the probability of good quality, for each row of docs(doc_id, text)."""

    def run(batches):
        for batch in sliced(batches):
            got = list(net.score([t.encode("utf-8", "surrogatepass") for t in texts_of(batch, "text")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(got) if got else [], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, net: Network, threshold: float) -> DataFrame:
    """The rows of docs whose score is at least threshold."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in sliced(batches):
            got = list(net.score([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]))
            if got:
                yield batch.filter(pa.array(np.concatenate(got) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def verdict(scored: DataFrame, threshold: float, folds: int, left_out: int) -> DataFrame:
    held: Column = fold(F.col("doc_id"), folds) == left_out
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
