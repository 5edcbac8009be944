"""Written intermediate tables, union-find over arrays, and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a local one where unset on a local master."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = f"file://{tempfile.mkdtemp(prefix='folio-')}"
        spark.sparkContext.setCheckpointDir(_own_scratch[app])
    return _own_scratch[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the driver's JVM ends, or earlier by discard().
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._folio_path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Forest:
    """Union-find over 0..n-1 that takes whole arrays of links; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self.flatten()

    def flatten(self) -> None:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Links (a, b) of longs that connect what each task's edges(a, b) connect: fewer than a task has nodes."""

    def run(batches):
        a = b = np.empty(0, np.int64)
        for batch in batches:
            x = np.concatenate((a, batch.column(0).to_numpy(zero_copy_only=False)))
            y = np.concatenate((b, batch.column(1).to_numpy(zero_copy_only=False)))
            nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
            forest = Forest(len(nodes))
            forest.add(at[: len(x)], at[len(x) :])
            linked = np.flatnonzero(forest.parent != np.arange(len(nodes)))
            a, b = nodes[linked], nodes[forest.parent[linked]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, one_task_up_to: int = 0) -> DataFrame:
    """Connected components of edges(a, b): (node, root), root the smallest node reachable.

    Up to one_task_up_to distinct links, counted first, go through one task's
    forest (nodes must then be longs); beyond that, and by default:

    Alternates the large-star and small-star steps over whole tables until the
    links form stars. A hub's rows are split by the skew handling of the joins,
    minima are pre-aggregated, and each round is a written table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    now, seen = materialize(pairs, "links"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hi, lo))").alias("x")).first()
        if seen is None and 0 < mark["n"] <= one_task_up_to:
            return spanning_forest(now.select(F.col("hi").alias("a"), F.col("lo").alias("b")).coalesce(1)).toDF("node", "root")
        if mark == seen or not mark["n"]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = mark
        # large star: every larger neighbour of u points at the smallest around u
        around = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "links")
        # small star: u and its smaller neighbours point at the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        down = large.join(least, "hi")
        small = down.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", "m")).where("hi <> lo").distinct()
        following = materialize(small, "links")
        discard(now)
        discard(large)
        now = following
