"""Toxicity: a counterfactually regularised classifier.

A logistic model over the words of a text and their beginnings is fitted on the
driver from a bounded sample of labelled texts. Every labelled text that names a
group also appears with the names swapped for other groups' names, and every
MENTIONED-th labelled text gets a name of a group put among its words, which is
swapped likewise and learned under the text's own label; the squared changes of the
scores are penalised, so that naming a group neutrally doesn't raise a score,
whichever names the labelled texts hold. Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text scores as a text without known words; ties
and repeated rows score alike; a null doc_id is kept; without labels of both
classes every score is the labels' rate (0.5 without any); an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labelled import Adam, sample
from ._shared import sliced, texts_of

#: At most so many documents of a class are learned from, by so many features.
EACH, FEATURES = 1500, 1024
#: A feature must part the classes by so many standard errors, or be so many times likelier in one class, in so many texts of it.
SURE, LIKELIER, TEXTS = 4.0, 16.0, 8
#: One in so many labelled texts gets a name of a group put among its words.
MENTIONED = 4
#: Names of groups, by what can stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "musulmán", "cristiano", "judío", "musulman", "chrétien", "juif", "muslimisch", "christlich", "jüdisch"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "native", "inmigrante", "refugiado", "immigré", "réfugié", "einwanderer", "flüchtling"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)
_TERMS = {t: (g, i) for g, group in enumerate(IDENTITY) for i, t in enumerate(group)}
_WORD = re.compile(r"\w+")
_BEGIN = 4


def words_of(text: str) -> frozenset[str]:
    return frozenset(_WORD.findall(text.lower()))


def features(words: frozenset[str]) -> set[str]:
    """The distinct words, and each longer word's beginning (marked by a hyphen)."""
    return words | {w[:_BEGIN] + "-" for w in words if len(w) > _BEGIN}


def _other(term: str, turn: int) -> str:
    g, i = _TERMS[term]
    return IDENTITY[g][(i + turn) % len(IDENTITY[g])]


def swapped(words: frozenset[str], turn: int) -> frozenset[str]:
    """The words with each group's name replaced by the name `turn` places on."""
    return frozenset(_other(w, turn) if w in _TERMS else w for w in words)


def mentioning(words: frozenset[str], i: int) -> frozenset[str]:
    """The words and a name of a group that is not among them; i chooses it."""
    group = IDENTITY[i % len(IDENTITY)]
    free = [t for t in group if t not in words] or list(group)
    return words | {free[i // len(IDENTITY) % len(free)]}


class Model:
    def __init__(self, weights: dict[str, float], bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant
        self.words = frozenset(f for f in weights if not f.endswith("-"))
        self.begins = frozenset(f[:-1] for f in weights if f.endswith("-"))

    def logit(self, text: str) -> float:
        words = words_of(text)
        known = [*(words & self.words), *(b + "-" for b in {w[:_BEGIN] for w in words if len(w) > _BEGIN} & self.begins)]
        return self.bias + sum(self.weights[f] for f in sorted(known))

    def score(self, text: str) -> float:
        return self.constant if self.constant is not None else float(_sigmoid(self.logit(text)))


_sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _weights(texts: list[frozenset[str]], found: list[set[str]], y: np.ndarray, steps: int, penalty: float, shrink: float, swaps: int) -> Model:
    """Balanced logistic loss + penalty * squared score changes under swaps + shrink * squared weights, by Adam."""
    ones = [Counter(), Counter()]
    for f, k in zip(found, y.tolist(), strict=True):
        ones[k].update(f)
    n = [int((y == k).sum()) for k in (0, 1)]

    def told(f: str) -> float:
        p, a, b = (ones[0][f] + ones[1][f]) / sum(n), ones[0][f] / n[0], ones[1][f] / n[1]
        return abs(a - b) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))

    known = [f for f in set(ones[0]) | set(ones[1]) if ones[0][f] + ones[1][f] >= 3]
    ranked = sorted(((told(f), f) for f in known), key=lambda x: (-x[0], x[1]))[:FEATURES]

    def one_sided(f: str) -> bool:
        rates = [(ones[k][f] + 0.5) / n[k] for k in (0, 1)]
        k = int(rates[1] > rates[0])
        return ones[k][f] >= TEXTS and rates[k] >= LIKELIER * rates[1 - k]

    chosen = [f for z, f in ranked if z >= SURE or one_sided(f)] or [f for _, f in ranked[:32]]  # chance alone reaches SURE for few of many words
    groups = {f for t in _TERMS for f in (t, *([t[:_BEGIN] + "-"] if len(t) > _BEGIN else []))}
    names = list(dict.fromkeys([*chosen, *sorted(groups)]))
    told_apart = [i for k in (0, 1) for i in np.flatnonzero(y == k)[::MENTIONED].tolist()]
    texts = [*texts, *(mentioning(texts[i], j) for j, i in enumerate(told_apart))]
    found, y = [*found, *map(features, texts[len(found) :])], np.concatenate((y, y[told_apart]))
    n = [int((y == k).sum()) for k in (0, 1)]
    at = {f: i for i, f in enumerate(names)}

    def rows(sets: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(sets), len(names)), np.float32)
        for i, s in enumerate(sets):
            out[i, [at[f] for f in s if f in at]] = 1
        return out

    x = rows(found)
    naming = [i for i, t in enumerate(texts) if not _TERMS.keys().isdisjoint(t)]
    pairs = [rows([features(swapped(texts[i], k)) for i in naming]) for k in range(1, swaps + 1)] if naming else []
    own = x[naming]
    w = {"w": np.zeros(len(names), np.float32), "b": np.zeros(1, np.float32)}
    adam = Adam(w, 0.05)
    balance = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]).astype(np.float32)
    for step in range(steps):
        if step == steps * 2 // 3:
            adam.rate = 0.01
        d = (_sigmoid(x @ w["w"] + w["b"][0]) - y) * balance
        g = {"w": x.T @ d + shrink * w["w"], "b": np.array([d.sum()], np.float32)}
        for other in pairs:
            p, q = _sigmoid(own @ w["w"] + w["b"][0]), _sigmoid(other @ w["w"] + w["b"][0])
            dp, dq = 2 * (p - q) * p * (1 - p), 2 * (p - q) * q * (1 - q)
            scale = penalty / (len(naming) * len(pairs))
            g["w"] = g["w"] + scale * (own.T @ dp - other.T @ dq)
            g["b"] = g["b"] + scale * (dp.sum() - dq.sum())
        adam.step(g)
    return Model({f: float(v) for f, v in zip(names, w["w"], strict=True) if abs(v) > 1e-4}, float(w["b"][0]))


def _scaling(z: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Slope and offset that turn z into a probability where label 1 has the given rate (Newton's method)."""
    n = [(y == k).sum() for k in (0, 1)]
    weight = np.where(y == 1, rate / n[1], (1 - rate) / n[0]) * len(y)
    goal = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x, v = np.stack([z, np.ones_like(z)], 1), np.array([1.0, np.log(rate / (1 - rate))])
    for _ in range(50):
        p = _sigmoid(x @ v)
        grad = x.T @ (weight * (p - goal)) + 0.1 * np.array([v[0] - 1, 0])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        v -= step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(v[0]), 0.1), float(v[1])


def fit(texts: list[str], y: list[int], rate: float, steps: int = 200, penalty: float = 1.0, shrink: float = 1e-5, swaps: int = 2, parts: int = 4) -> Model:
    """The weights of all rows, scaled by how the weights without a part of the rows score that part."""
    texts, y_ = [t or "" for t in texts], np.array(y)
    if len(set(y)) < 2:
        return Model({}, 0.0, rate)
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    words = [words_of(t) for t in texts]
    found, rule = [features(w) for w in words], (steps, penalty, shrink, swaps)
    model = _weights(words, found, y_, *rule)
    z, part_of = np.zeros(len(y)), np.zeros(len(y), int)
    for k in (0, 1):
        at = np.flatnonzero(y_ == k)
        part_of[at] = np.arange(len(at)) % parts
    for side in range(parts):
        own, other = np.flatnonzero(part_of != side), np.flatnonzero(part_of == side)
        if len(set(y_[own].tolist())) < 2 or not len(other):
            return model
        part = _weights([words[i] for i in own], [found[i] for i in own], y_[own], *rule)
        z[other] = [part.logit(texts[i]) for i in other]
    slope, offset = _scaling(z, y_, rate)
    return Model({f: slope * v for f, v in model.weights.items()}, slope * model.bias + offset)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, left_out: int = 0, each: int = EACH) -> Model:
    return fit(*sample(docs, labels, "toxic", folds, left_out, each))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of toxicity, for each row of docs(doc_id, text)."""

    def run(batches):
        for batch in sliced(batches):
            got = [model.score(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
