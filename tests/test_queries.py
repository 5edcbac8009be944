"""Queries of the catalogue against their SQL, over small tables with odd rows."""

import os
import random
import struct
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folio import catalog_queries
from folio.functions import similarity, text
from folio.operators import grouping
from folio.plans.pairs import paired
from folio.schema import Weights

BASE = "/root/testdata/sf0.001"


def tables(folder, **changed):
    """A folder with the smallest tables, but for the changed ones."""
    for name in os.listdir(BASE):
        if name.removesuffix(".parquet") not in changed:
            os.symlink(f"{BASE}/{name}", folder / name)
    for name, rows in changed.items():
        pq.write_table(rows, folder / f"{name}.parquet")
    return str(folder)


def by_sql(name, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return sorted(con.execute(catalog_queries.ORACLES[name]).fetchall())


def by_query(spark, name, sf_dir):
    return sorted(tuple(r) for r in catalog_queries.QUERIES[name](spark, sf_dir).collect())


def edge_cells():
    """Single-precision x > 0 of which (x + 1) * 127 reaches a whole number by rounding only."""
    single = lambda v: struct.unpack("f", struct.pack("f", v))[0]
    found = []
    for k in range(128, 254):
        x = single(k / 127 - 1)
        for x in (x, single(x - 1e-8), single(x - 3e-8), single(x - 6e-8)):
            if int((x + 1) * 127) < k <= single(single(x + 1) * 127):
                found.append((k, x))
    return found


def edge_embeddings():
    """Vectors whose one cell of that kind lies at the mean of all, so that its bit tells the precision."""
    found = edge_cells()
    assert found
    whole = [[x, (k + 1.5) / 127 - 1] + [(k + 0.5) / 127 - 1] * 62 for k, x in found] + [[0.5] * 64]
    return pa.table({"vec_id": pa.array(range(len(whole)), pa.int64()), "embedding": pa.array(whole, pa.list_(pa.float32())), "label": pa.array([0] * len(whole), pa.int32())})


@pytest.mark.parametrize("name", ["hamming_pairs", "phash_bits", "phashes_set", "preview_phash", "previews_replaced"])
def test_hashes_of_edge_cells_equal_sql(spark, tmp_path, name):
    sf_dir = tables(tmp_path, embeddings=edge_embeddings())
    assert by_query(spark, name, sf_dir) == by_sql(name, sf_dir)


def test_folder_tree_splits_no_path_of_a_pair(spark, tmp_path):
    sf_dir = tables(tmp_path)
    df = catalog_queries.QUERIES["folder_tree"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any("regexp" in line for line in plan[:first])
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))
    assert sorted(tuple(r) for r in df.collect()) == by_sql("folder_tree", sf_dir)


def test_slices_meet_once(spark):
    a = spark.createDataFrame([(x % 2, x) for x in range(40)], "k int, a int")
    b = spark.createDataFrame([(x % 3, x) for x in range(30)], "k int, b int")
    want = sorted((x % 2, x, y) for x in range(40) for y in range(30) if x % 2 == y % 3)
    assert sorted(map(tuple, paired(a, b, ["k"], 3).collect())) == want


def test_score_pairs_splits_no_path_of_a_pair(spark, tmp_path):
    sf_dir = tables(tmp_path)
    df = catalog_queries.QUERIES["score_pairs"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan[: plan.index("Join")]
    assert sorted(tuple(r) for r in df.collect()) == by_sql("score_pairs", sf_dir)


def test_links_are_counted_without_pairs(spark, monkeypatch):
    rng = random.Random(5)
    folders = ["/", "/w", "/w/a", "/w/a/b", "/v", ".", "x", "x/y"]
    bases = [rng.getrandbits(63) for _ in range(4)]
    rows = []
    for k in range(240):
        folder = rng.choice(folders)
        name = rng.choice(["rose", "rosa", "roses", "tulip", "tulips red", ""])
        bits = None if rng.random() < 0.4 else rng.choice(bases) ^ (rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63)) ^ -(rng.getrandbits(1) << 63)
        at = None if rng.random() < 0.03 else datetime(2026, 9, 9) + timedelta(minutes=rng.randrange(1500))
        rows.append(({"/": "/", ".": ""}.get(folder, folder + "/") + f"{k}.psd", 1, name, at, bits))
    cands = spark.createDataFrame(rows, "path string, asset_id long, name string, modified_at timestamp_ntz, bits long")
    for w in (Weights(), Weights(threshold=0.8), Weights(threshold=0.85, time_window_s=0)):
        pairs = grouping.scored_pairs(cands, w)
        want = Counter(p for r in pairs.select("path_a", "path_b").collect() for p in r)
        assert want and dict(map(tuple, grouping.link_counts(cands, w).collect())) == want
    with monkeypatch.context() as m:
        m.delattr(grouping, "scored_pairs")
        assert catalog_queries.QUERIES["link_counts"](spark, BASE).count()


def test_slices_of_one_table_meet_once(spark):
    a = spark.createDataFrame([(x % 2, x % 2 == 0, x) for x in range(40)], "k int, own boolean, a int")
    b = spark.createDataFrame([(x % 2, x) for x in range(40)], "k int, b int")
    for slices in (1, 3):
        got = [tuple(r) for r in paired(a, b, ["k"], slices, ("own", "a", "b")).select("k", "a", "b").collect()]
        assert sorted((k, *sorted((x, y))) for k, x, y in got if k == 0) == [(0, x, y) for x in range(0, 40, 2) for y in range(x + 2, 40, 2)]
        assert sorted(r for r in got if r[0]) == [(1, x, y) for x in range(1, 40, 2) for y in range(1, 40, 2)]


def test_files_out_of_reach_do_not_meet(spark, monkeypatch):
    met = []
    monkeypatch.setattr(grouping, "paired", lambda *args: met.append(paired(*args)) or met[-1])
    # names 0.6 alike link within two hours, names 0.5 alike only by pictures
    rows = [(f"/{name}/{k}.psd", 1, name, datetime(2026, 9, 9) + timedelta(days=k, minutes=k % 200), None) for name in ("aaaaaabbbb", "aaaaaacccc", "aaaaabdddd") for k in range(100)]
    cands = spark.createDataFrame(rows, "path string, asset_id long, name string, modified_at timestamp_ntz, bits long")
    links = grouping.scored_pairs(cands).count()
    assert links == 3 * 4950 + 100
    assert sum(df.count() for df in met) <= 3 * 4950 + 300


def test_score_pairs_within_reach_equal_all_pairs(spark):
    rng = random.Random(7)
    bases, folders = [rng.getrandbits(63) for _ in range(3)], ["/w", "/w/a", "/v"]
    rows = []
    for k in range(160):
        bits = None if rng.random() < 0.5 else rng.choice(bases) ^ (rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63)) ^ -(rng.getrandbits(1) << 63)
        at = None if rng.random() < 0.05 else datetime(1969, 12, 31) + timedelta(minutes=rng.choice([rng.randrange(3000), 480 * rng.randrange(6)]))
        rows.append((f"{rng.choice(folders)}/{k}.psd", 1, rng.choice(["hot rod", "hot rope", "old rod", "cold rod", "cold plate", "hot plate", "", None]), at, bits))
    cands = spark.createDataFrame(rows, "path string, asset_id long, name string, modified_at timestamp_ntz, bits long").cache()
    a, b = grouping._sides(cands)
    columns = ["path_a", "path_b", "name_score", "time_score", "image_score", "has_image", "distance", "vetoed", "total"]
    for w in (Weights(), Weights(threshold=0.8), Weights(threshold=0.75, time_window_s=0), Weights(name=0.5, time=0.5, image=0.0), Weights(name=0.8, time=0.0), Weights(threshold=1.0), Weights(time_window_s=1)):
        parts = similarity.score(*(F.col(f"{x}_{s}") for x in ("name", "modified_at", "bits", "path") for s in "ab"), w)
        want = a.crossJoin(b).where("path_a < path_b").where((F.col("name_a").isNotNull() & F.col("name_b").isNotNull()) & (parts["total"] >= w.threshold)).select("path_a", "path_b", *(v.alias(k) for k, v in parts.items()))
        assert Counter(map(tuple, grouping.scored_pairs(cands, w).select(columns).collect())) == Counter(map(tuple, want.select(columns).collect())), w


def test_files_are_copied_only_as_common_names_ask_for(spark, monkeypatch):
    copies = []
    monkeypatch.setattr(grouping, "paired", lambda a, b, keys, slices, own: copies.append((keys, slices)) or paired(a, b, keys, slices, own))

    def slices_of(names, each):
        copies.clear()
        rows = [(f"/{name}/{k}.psd", 1, name, datetime(2026, 9, 9) + timedelta(days=k), None) for name in names for k in range(each)]
        cands = spark.createDataFrame(rows, "path string, asset_id long, name string, modified_at timestamp_ntz, bits long")
        assert grouping.scored_pairs(cands).count() == len(names) * each * (each - 1) // 2
        return {len(keys): slices for keys, slices in copies[:2]}

    assert slices_of(["rose"], 40)[1] == 8
    assert slices_of([c * 6 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"], 4) == {1: 2, 2: 1}


def test_near_files_are_copied_to_two_stretches_without_folders(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(grouping, "paired", lambda a, b, *rest: sides.append((a, b)) or paired(a, b, *rest))
    # these names link within two hours
    rows = [(f"/{name}/{k}.psd", 1, name, datetime(2026, 9, 9) + timedelta(minutes=37 * k), None) for name in ("aaaaaabbbb", "aaaaaacccc") for k in range(200)]
    cands = spark.createDataFrame(rows, "path string, asset_id long, name string, modified_at timestamp_ntz, bits long")
    assert grouping.scored_pairs(cands).where("name_score < 1").count() == sum(abs(i - j) * 37 <= 120 for i in range(200) for j in range(200))
    left, right = sides[1]
    assert right.count() == 200 and left.count() <= 2.1 * 200
    for left, right in sides:
        assert {c for c, kind in left.dtypes + right.dtypes if kind == "string"} <= {"path_a", "path_b", "name_b"}


def test_folder_trees_from_lengths(spark):
    paths = ["", "/", "a", ".a", "./a", "./b/c", "../a", "/a", "//a", "/a/b", "/a/c/d", "/ab/c", "a/b/", "a//b", "a/b/c", "ab/c", "a\nb/c", "ä/ß/x.psd", "ä/y", "\U0001f339/x", "\U0001f339/y/z"]
    df = spark.createDataFrame([(x, y) for x in paths for y in paths], "a string, b string").withColumns({f"n_{s}": text.dir_length(F.col(s)) for s in "ab"})
    got = df.select("a", "b", text.related_by_length(*map(F.col, ("a", "b", "n_a", "n_b"))).alias("got"), text.same_folder_tree(F.col("a"), F.col("b")).alias("want")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []
