"""Language identification by mixture inference.

Every language has a table of byte-trigram log-likelihoods, fitted on the driver
from a bounded sample of labelled texts. A text is a sequence of units of a few
words; expectation-maximisation estimates the shares of the languages from the
units' likelihoods. Starting from all languages, the one of least share is
dropped while the likelihood, penalised by half a log of the units for each
language, doesn't fall. The largest share names the language. Whole texts, one
pass, no shuffle.

Defined cases: a null text, or one without a letter, (str.isalpha) is "und" with score 0; so
is everything when no labelled text could be learned from. Ties go to the first
language by name; repeated rows get the same answer; a null doc_id is kept; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import discard, fold, in_slices, materialize, sliced, texts_of

#: At most so many documents of a language are learned from.
EACH = 800
BUCKETS = 1 << 16
UNIT = 4
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, all but letters as spaces, and where each text begins; spaces enclose each."""
    raw = [f" {t.lower()}  ".encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in raw])[:-1])).astype(np.int64) if raw else np.empty(0, np.int64)
    return np.where(_INSIDE[data], data, np.uint8(32)), starts


def _grams(data: np.ndarray) -> np.ndarray:
    """A bucket for the trigram at each byte but the last two."""
    d = data.astype(np.uint32)
    h = d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA6B) ^ d[2:] * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(16)).astype(np.int64)


class Model:
    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Likelihoods of the units relative to their best language, and each text's first unit. Texts hold a letter each."""
        data, starts = _letters(texts)
        space = data == 32
        begins = np.flatnonzero(space[:-1] & ~space[1:])  # the space before each word
        n_before = np.searchsorted(begins, starts)  # each text's first word
        words = np.diff(np.append(n_before, len(begins)))
        of = np.repeat(np.arange(len(texts)), words)
        first = (np.arange(len(begins)) - n_before[of]) % UNIT == 0
        cuts, of = begins[first], of[first]
        # from one unit's first space to the next unit's; what lies between texts is spaces
        like = np.add.reduceat(self.table.take(_grams(data), 0), cuts, 0)
        like -= like.max(1, keepdims=True)
        counts = np.bincount(of, minlength=len(texts))
        return np.maximum(np.exp(like), 1e-6), np.concatenate(([0], np.cumsum(counts)[:-1]))

    def shares(self, texts: list[str], first_rounds: int = 8, later_rounds: int = 4) -> np.ndarray:
        """Each text's shares of the languages of its selected set."""
        like, offset = self.units(texts)
        n = np.diff(np.append(offset, len(like)))
        of = np.repeat(np.arange(len(texts)), n)

        def maximise(share, like, of, offset, n, rounds):
            for _ in range(rounds):
                mass = like * share[of]
                mass /= np.maximum(mass.sum(1, keepdims=True), 1e-30)
                share = np.add.reduceat(mass, offset, 0) / n[:, None]
            total = np.log(np.maximum((like * share[of]).sum(1), 1e-30))
            return share, np.add.reduceat(total, offset)

        k = len(self.names)
        share, fits = maximise(np.full((len(texts), k), 1 / k, np.float32), like, of, offset, n, first_rounds)
        size = np.full(len(texts), k)
        open_ = np.arange(len(texts))  # whose set may still shrink
        for _ in range(k - 1):
            if not len(open_):
                break
            rows = np.isin(of, open_) if len(open_) < len(texts) else np.ones(len(of), bool)
            n_ = n[open_]
            offset_ = np.concatenate(([0], np.cumsum(n_)[:-1]))
            fewer = share[open_].copy()
            held = np.where(fewer > 0, fewer, np.inf)
            fewer[np.arange(len(open_)), held.argmin(1)] = 0
            fewer = (fewer + 1e-3 * (fewer > 0)) / np.maximum((fewer + 1e-3 * (fewer > 0)).sum(1, keepdims=True), 1e-30)
            fewer, fit_ = maximise(fewer.astype(np.float32), like[rows], np.repeat(np.arange(len(open_)), n_), offset_, n_, later_rounds)
            better = (fit_ + 0.5 * np.log(n_) >= fits[open_]) & (size[open_] > 1)
            done = open_[better]
            share[done], fits[done] = fewer[better], fit_[better]
            size[done] -= 1
            open_ = done
        return share

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if self.names else []
        for a, b in in_slices(lettered, lambda i: len(texts[i]), 1 << 19):
            share = self.shares([texts[i] for i in lettered[a:b]])
            for i, at, top in zip(lettered[a:b], share.argmax(1).tolist(), share.max(1).tolist(), strict=True):
                names[i], scores[i] = self.names[at], min(1.0, max(0.0, float(top)))
        return names, scores


def fit(texts: list[str], langs: list[str], smooth: float = 0.05) -> Model:
    names = sorted(set(langs))
    table = np.zeros((BUCKETS, len(names)), np.float32)
    for k, name in enumerate(names):
        counts = np.zeros(BUCKETS)
        for a, b in in_slices(own := [t for t, x in zip(texts, langs, strict=True) if x == name], len, 1 << 20):
            grams = _grams(data := _letters(own[a:b])[0])
            counts += np.bincount(grams[(data[:-2] != 32) | (data[1:-1] != 32)], minlength=BUCKETS)
        table[:, k] = np.log((counts + smooth) / (counts.sum() + smooth * BUCKETS))
    # what only spaces make says nothing
    table[_grams(np.full(3, 32, np.uint8))[0]] = 0
    return Model(names, table)


def train(docs: DataFrame, folds: int = 4, left_out: int = 2, each: int = EACH, most_bytes: int = 1 << 16) -> Model:
    """Fit on at most `each` texts of a language, those of least hash; texts of over most_bytes bytes are not learned from."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != left_out))
    first = Window.partitionBy("lang").orderBy("u", "doc_id", "at")
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    keys = materialize(usable.where(F.octet_length("text") <= most_bytes).select("lang", "doc_id", F.xxhash64("text").alias("at"), u.alias("u")), "keys")
    # of a language with n rows, those of least hash lie below about each / n of the range, surely below four times that
    low = F.col("u").cast("double") * F.col("n") < 4.0 * each * (1 << 40)
    counts = keys.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language, of which the driver holds `each` texts anyway
    few = keys.join(F.broadcast(counts), "lang").where(low)
    ids = materialize(few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).select("lang", "doc_id", "at"), "sample")
    discard(keys)
    texts = usable.where(F.octet_length("text") <= most_bytes).withColumn("at", F.xxhash64("text"))
    rows = texts.join(ids.distinct(), ["lang", "doc_id", "at"]).select("lang", "text", "doc_id").distinct().select("lang", "text").toArrow()
    rows = sorted(zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True))
    discard(ids)
    return fit([r[1] for r in rows], [r[0] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text)."""

    def run(batches):
        for batch in sliced(batches):
            names, scores = model.predict(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
