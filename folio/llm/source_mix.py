"""Mixing sources to target weights by min-cost flow.

Documents are pre-aggregated by membership pattern (the set of sources they
belong to). On the driver, a flow from patterns to source quotas uses each
pattern's words once for free and again at a convex cost, so repeats are used
last and evenly. Of a pattern's flow, whole passes go to every document; for
the part of a pass that is left, documents are taken in the order of a seeded
hash up to a cut that histograms of the hash locate, and a few best-fitting
documents close the gap. Only a few numbers a pattern reach the driver; how many
patterns there are depends on the sources, not on the documents.

Defined cases: a null or empty sources array or text is allowed (no source: not
taken; no words: taken 0); a null source is a source of its own, ordered last;
repeated rows are documents of their own and share their hash; a null doc_id
has a fixed hash; an empty table gives an empty table; extra columns of any
name stay in place in apply(), but for one called `taken`, which the result replaces.
"""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, columns_of

_BITS = 10


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def by_code_point(sources) -> list:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, weights=(1, 2, 3), most: int = 3) -> dict:
    """Words for each source: shares of all words by repeating weights, at most `most` times its size, the excess reshared."""
    order = by_code_point(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def flow(patterns: dict, quotas: dict, most: int = 3) -> dict:
    """Words to take of each pattern, {(pattern, source): words}.

    patterns: {frozenset of sources: words}; quotas: {source: words}. Pass r over
    a pattern costs r - 1 for each word; the flow is a largest one of least cost,
    by shortest augmenting paths over the residual graph.
    """
    routes: dict = defaultdict(int)  # pattern -> source
    used: dict = defaultdict(int)  # of a pattern, in all passes
    left = {s: int(q) for s, q in quotas.items()}
    for tier in range(1, most + 1):  # all words of a pass cost the same, so passes fill one after another
        while True:
            # breadth first from every pattern with room in this pass to any source with quota left
            came: dict = {("p", p): None for p in patterns if used[p] < tier * patterns[p]}
            queue, goal = list(came), None
            for node in queue:
                kind, x = node
                if kind == "s" and left[x] > 0:
                    goal = node
                    break
                nexts = [("s", s) for s in by_code_point(x) if s in left] if kind == "p" else [("p", p) for p in patterns if routes[p, x] > 0]
                for y in nexts:
                    if y not in came:
                        came[y] = node
                        queue.append(y)
            if goal is None:
                break
            path = [goal]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            start = path[0][1]
            amount = min(tier * patterns[start] - used[start], left[goal[1]], *(routes[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"))
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    routes[a[1], b[1]] += amount
                else:
                    routes[b[1], a[1]] -= amount
            used[start] += amount
            left[goal[1]] -= amount
    return {k: v for k, v in routes.items() if v}


class Plan:
    """What mix() decides: whole passes for each pattern, and who is taken once more.

    A row is taken once more if its hash lies below its pattern's cut, or if it
    is one of the few documents chosen to close the gap.
    """

    def __init__(self, names: list[str], passes: list[int], left: np.ndarray, most: int, seed: int):
        self.names, self.passes, self.left, self.most, self.seed = names, passes, left, most, seed
        self.cut = np.zeros(len(names), np.int64)
        self.chosen: list[list[str]] = [[] for _ in names]

    def keyed(self, rows: DataFrame) -> DataFrame:
        """rows(doc_id, size, sources, ...) with their pattern's number p, passes, cut and left, their hash u and whether they are chosen.

        The plan is a table of one row a pattern, so Spark sees its size and picks the join.
        """
        spark = rows.sparkSession
        known = pa.table({"pattern": pa.array(self.names, pa.string()), "p": pa.array(range(len(self.names)), pa.int64()), "passes": pa.array(self.passes, pa.int64()), "cut": pa.array(self.cut, pa.int64()), "left": pa.array(self.left, pa.int64())})
        picked = [(p, d) for p, ds in enumerate(self.chosen) for d in ds]
        picked = pa.table({"p": pa.array([p for p, _ in picked], pa.int64()), "id": pa.array([d for _, d in picked], pa.string()), "chosen": pa.array([True] * len(picked), pa.bool_())})
        rows = rows.withColumns({"pattern": pattern(F.col("sources")), "id": F.col("doc_id").cast("string"), "u": F.pmod(F.xxhash64(F.lit(self.seed), "doc_id"), F.lit(1 << 2 * _BITS))})
        rows = rows.join(spark.createDataFrame(known), "pattern", "left")
        return rows.join(spark.createDataFrame(picked), ["p", "id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))

    def apply(self, rows: DataFrame, size: Column, sources: Column) -> DataFrame:
        """rows with a last column `taken`; an input column of that name goes, all others stay whatever their names."""
        whole = F.struct(*(c for name, c in zip(rows.columns, columns_of(rows), strict=True) if name.lower() != "taken"))
        keyed = self.keyed(rows.select(whole.alias("row"), F.col("doc_id"), size.alias("size"), sources.alias("sources")))
        passes = F.least(((F.col("u") < F.col("cut")) | F.col("chosen")).cast("long") + F.col("passes"), F.lit(self.most))
        return keyed.select("row.*", F.coalesce(F.col("size") * passes, F.lit(0)).cast("long").alias("taken"))


def pattern(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.expr("cast(array() as array<string>)")))))


def mix(rows: DataFrame, quotas: dict, most: int = 3, seed: int = 42, rounds: int = 5) -> Plan:
    """The plan that takes about quotas[source] words of each source from rows(doc_id, size, sources array<string>).

    rows is read a few times, so give a written table. No row is taken more than `most` times.
    """
    rows = rows.select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "sources")
    sums = {r["p"]: r["n"] for r in rows.groupBy(pattern(F.col("sources")).alias("p")).agg(F.sum("size").alias("n")).collect()}
    names = sorted(sums)
    sets = [frozenset(json.loads(p)) for p in names]
    sizes = dict(zip(sets, (sums[p] for p in names), strict=True))
    taken: dict = defaultdict(int)
    for (p, _), n in flow(sizes, {s: round(q) for s, q in quotas.items()}, most).items():
        taken[p] += n
    passes = [taken[p] // sizes[p] if sizes[p] else 0 for p in sets]
    left = np.array([taken[p] - k * sizes[p] for p, k in zip(sets, passes, strict=True)], np.int64)
    plan = Plan(names, passes, left, most, seed)
    if not names:
        return plan
    # the cut of each pattern's hash: coarse buckets, then those inside the coarse bucket that holds it
    for shift in (_BITS, 0):
        inside = plan.keyed(rows).where(F.col("u").between(F.col("cut"), F.col("cut") + ((1 << shift + _BITS) - 1)))
        buckets = inside.groupBy("p", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        buckets = buckets.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("bucket")))
        fits = F.col("upto") <= F.col("left")
        found = {r["p"]: r for r in buckets.groupBy("p").agg(F.min(F.when(~fits, F.col("bucket"))).alias("bucket"), F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("n")).collect()}
        for p in range(len(names)):
            bucket = found[p]["bucket"] if p in found else None
            plan.cut[p] = bucket << shift if bucket is not None else plan.cut[p] + (1 << shift + _BITS)
            plan.left[p] -= found[p]["n"] if p in found else 0
    for turn in range(rounds + 1):  # the largest document that fits; at last one that may run over
        gap = F.col("left") - F.col("size") if turn < rounds else F.abs(F.col("size") - F.col("left"))
        open_ = plan.keyed(rows).where((F.col("u") >= F.col("cut")) & (F.col("size") > 0) & gap.between(F.lit(0), F.col("left") - 1) & F.col("doc_id").isNotNull() & ~F.col("chosen"))
        best = open_.groupBy("p").agg(F.min(F.struct(gap.alias("gap"), "u", "doc_id", "size")).alias("b")).collect()
        for r in best:
            plan.chosen[r["p"]].append(str(r["b"]["doc_id"]))
            plan.left[r["p"]] = max(0, plan.left[r["p"]] - r["b"]["size"])
    return plan
