"""A bounded sample of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fold


def sample(docs: DataFrame, labels: DataFrame, name: str, folds: int, left_out: int, each: int, most_bytes: int = 1 << 20) -> tuple[list[str], list[int], float]:
    """Texts, their 0/1 labels and the rate of label 1 among all usable labels.

    At most `each` documents of a class, those of least hash; texts of over
    most_bytes bytes are left out of the sample (never of scoring). Repeated
    labels of a document count once, as the largest; rows with a null doc_id or
    label, and those of the fold left out, are not used.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1) & (fold(F.col("doc_id"), folds) != left_out))
    usable = usable.groupBy("doc_id").agg(F.max(name).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = usable.where("y = 0").orderBy(*order).limit(each).union(usable.where("y = 1").orderBy(*order).limit(each))
    # at most 2 * each rows of two numbers, whatever the tables hold
    texts = docs.select("doc_id", "text").where((F.octet_length("text") <= most_bytes)).join(F.broadcast(ids), "doc_id")
    rows = sorted({(r["doc_id"], r["text"], r["y"]) for r in texts.collect()})
    total = sum(counts.values())
    return [r[1] for r in rows], [r[2] for r in rows], counts.get(1, 0) / total if total else 0.5


class Adam:
    """Adam over a dict of numpy arrays."""

    def __init__(self, values: dict, rate: float):
        import numpy as np

        self.values, self.rate, self.t = values, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in values.items()}
        self.s = {k: np.zeros_like(v) for k, v in values.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            self.values[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / ((self.s[k] / (1 - 0.999**self.t)) ** 0.5 + 1e-8)
