"""Catalogue changes, content store, grouping, previews, retention and streams on small tables."""

import datetime as dt
import hashlib
import io
import itertools
import random
import zipfile
import zlib

import numpy as np

import pytest
from pyspark.sql import functions as F

from folio.operators import catalogue, changes, grouping, ingest, previews, retention, vault
from folio.plans import unions
from folio.schema import TABLES, Catalogue, IngestConfig
from folio.sources import folders, tables
from folio.streaming import debounce

T0 = dt.datetime(2026, 9, 9, 12)
HOUR = dt.timedelta(hours=1)


def at(n):
    return T0 + n * HOUR


def lit(t):
    return F.lit(t).cast("timestamp")


@pytest.fixture
def make(spark):
    def build(**rows):
        blank = tables.empty(spark)
        return Catalogue(**{**blank.__dict__, **{n: spark.createDataFrame(r, TABLES[n]) for n, r in rows.items()}})

    return build


def version(i, asset, h="h", t=0, path="/w/a.psd", present=True, pinned=False):
    return (i, asset, h, 10, at(t), at(t), path, path, present, None, pinned)


def tracked(path, asset, h="h", t=0):
    return (path, asset, h, 10, at(t), at(t), at(t))


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# --- changes -------------------------------------------------------------------


def test_ids_follow_in_order(spark):
    table = spark.createDataFrame([(7,), (3,)], "id long")
    new = spark.createDataFrame([(n,) for n in "edcbafg"], "name string").repartition(4)
    assert rows(changes.with_ids(table, new, "name"), "name", "id") == [(n, 8 + i) for i, n in enumerate("abcdefg")]


def test_new_version_flags_open_tickets(make):
    ticket = lambda i, v, s="open": (i, v, "waiting_on_me", s, "n", "w", at(0), None, None)
    c = make(versions=[version(1, 1), version(2, 1, t=1), version(3, 2)], tickets=[ticket(1, 1), ticket(2, 2, "closed"), ticket(3, 3), ticket(4, 5)])
    new = make(versions=[version(5, 1, t=5), version(6, 1, t=6)]).versions
    got = {r["id"]: (r["status"], r["flagged_at"]) for r in changes.flag_tickets(c.tickets, c.versions, new).collect()}
    # ticket 4 stands on the first new version itself, so the second one flags it
    assert got == {1: ("maybe_done", at(5)), 2: ("closed", None), 3: ("open", None), 4: ("maybe_done", at(6))}


def test_ticket_status_keeps_the_flag(make):
    c = make(tickets=[(1, 1, "waiting_on_me", "maybe_done", "n", "w", at(0), at(1), None)])
    closed = changes.set_ticket_status(c.tickets, 1, "closed", lit(at(2)))
    assert rows(closed, "status", "flagged_at", "closed_at") == [("closed", at(1), at(2))]
    assert changes.set_ticket_status(closed, 1, "open", lit(at(3))).first()["closed_at"] is None
    with pytest.raises(ValueError):
        changes.set_ticket_status(closed, 1, "lost", lit(at(3)))


def test_tickets_need_a_note(make, spark):
    add = lambda note, way: changes.add_tickets(make().tickets, spark.createDataFrame([(1, way, note, "w", at(0))], "version_id long, direction string, note string, who string, created_at timestamp"))
    assert rows(add("x", "waiting_on_me"), "id", "status") == [(1, "open")]
    for bad in (("", "waiting_on_me"), (None, "waiting_on_me"), ("x", "up")):
        with pytest.raises(ValueError):
            add(*bad)


def test_decisions_are_unordered_and_last_wins(make, spark):
    c = make(grouping_decisions=[("a", "b", "apart", at(0)), ("b", "c", "apart", at(0))])
    new = spark.createDataFrame([("b", "a", "together", at(2)), ("a", "b", "apart", at(1)), ("x", "x", "apart", at(1))], "a string, b string, decision string, decided_at timestamp")
    assert rows(changes.put_decisions(c.grouping_decisions, new), "path_a", "path_b", "decision") == [("a", "b", "together"), ("b", "c", "apart")]
    renames = spark.createDataFrame([("c", "a")], "old string, new string")
    # b-c becomes a-b, which exists and keeps its own decision
    got = changes.rename_in_decisions(changes.put_decisions(c.grouping_decisions, new), renames)
    assert rows(got, "path_a", "path_b", "decision") == [("a", "b", "together")]
    assert rows(changes.rename_in_decisions(c.grouping_decisions, spark.createDataFrame([("a", "z")], "old string, new string")), "path_a", "path_b") == [("b", "c"), ("b", "z")]


def test_release_is_idempotent_and_versions_are_permanent(make, spark):
    c = make(versions=[version(1, 1, "x"), version(2, 1, "y"), version(3, 2, "x", present=False)])
    gone = spark.createDataFrame([("x",)], "file_hash string")
    once = changes.release_content(c.versions, gone, lit(at(5)))
    assert rows(once, "id", "content_present", "content_released_at") == [(1, False, at(5)), (2, True, None), (3, False, None)]
    assert rows(changes.release_content(once, gone, lit(at(9)))) == rows(once)
    assert rows(changes.lost_versions(c.versions, once.where("id <> 2")), "id") == [(2,)]


def test_rules_find_what_breaks_them(make):
    c = make(
        assets=[(1, "a", at(0), at(0))], versions=[version(1, 1), version(2, 9, path="")], observed_files=[tracked("/w/x", 8)], tickets=[(1, 5, "up", "open", "n", "w", at(0), None, None)],
        grouping_decisions=[("b", "a", "apart", at(0))], chunks=[("c", 1, -1)],
    )
    assert rows(changes.rows_without_asset(c)) == [("observed_files", 8), ("versions", 9)]
    assert rows(changes.versions_without_key(c.versions), "id") == [(2,)]
    assert rows(changes.tickets_without_version(c), "id") == [(1,)]
    assert rows(changes.bad_values(c)) == [("chunks", "c"), ("grouping_decisions", "b"), ("tickets", "1")]
    with pytest.raises(changes.Stale):
        changes.guarded(1, 2)


def test_cards_drop_works_without_versions(make):
    c = make(assets=[(1, "a", at(0), at(1)), (2, "b", at(0), at(2)), (3, "c", at(0), at(3))], versions=[version(1, 1, t=1), version(2, 1, "k", t=1), version(3, 2, t=0)], observed_files=[tracked("/w/x", 1)], previews=[("k", "ok", "psd", 1, 1, 1, at(0), "", "png", False, "")])
    got = catalogue.asset_cards(c).collect()
    assert [(r["id"], r["version_id"], r["n_versions"], r["n_files"], r["thumb"]) for r in got] == [(2, 3, 1, 0, ""), (1, 2, 2, 1, "/thumb/k")]


def test_prefix_is_literal(make):
    c = make(observed_files=[tracked("/w/50%_a/x", 1), tracked("/w/50xxa/x", 1), tracked("/W/50%_a/x", 1)])
    assert rows(catalogue.files_under(c.observed_files, "/w/50%_a/"), "path") == [("/w/50%_a/x",)]
    assert len(rows(catalogue.files_under(c.observed_files, "/w/50%_a/", any_case=True))) == 2


def test_folders_are_cleaned_and_kept_once(make, spark):
    c = make(watched_folders=[("/w/a", at(0))])
    new = spark.createDataFrame([("/w/a/", at(5)), ("/w//b/.", at(5)), (".", at(5))], "path string, added_at timestamp")
    assert rows(changes.add_folders(c.watched_folders, new)) == [("/w/a", at(0)), ("/w/b", at(5))]


# --- content store ------------------------------------------------------------------


def test_gear_table_is_frozen():
    want = {0: 0x6E789E6AA1B965F4, 1: 0x06C45D188009454F, 42: 0x12C015A97019E937, 128: 0xE9C7191857E774B8, 255: 0xCBDC6D34B7C7534D}
    assert {i: int(vault.gear_table()[i]) for i in want} == want
    assert (vault.MIN_CHUNK, vault.TARGET_CHUNK, vault.MAX_CHUNK) == (256 << 10, 1 << 20, 4 << 20)


def plain_cuts(data, least, target, most, strict, lax):
    gear, cuts, base = [int(g) for g in vault.gear_table()], [], 0
    while base < len(data):
        end = n = min(len(data) - base, most)
        h = 0
        for i in range(least, n):
            h = ((h << 1) + gear[data[base + i]]) & (1 << 64) - 1
            if h >> 64 - (strict if i < target else lax) == 0:
                end = i
                break
        base += end
        cuts.append(base)
    return cuts


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000, 50_000])
def test_cuts_equal_the_sequential_hash(size):
    data = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    bounds = {"least": 64, "target": 512, "most": 2048, "strict": 11, "lax": 7}
    assert vault.cut_points(data, **bounds) == plain_cuts(data, *bounds.values())


def test_large_contents_keep_their_bounds():
    data = np.random.default_rng(1).integers(0, 256, 9 << 20, dtype=np.uint8).tobytes()
    sizes = np.diff([0, *vault.cut_points(data)])
    assert sizes.sum() == len(data) and (sizes[:-1] >= vault.MIN_CHUNK).all() and sizes.max() <= vault.MAX_CHUNK
    shifted = vault.cut_points(b"new head" * 1000 + data)
    assert len({len(data) - c for c in vault.cut_points(data)} & {len(data) + 8000 - c for c in shifted}) > len(sizes) // 2


BOUNDS = {"least": 64, "target": 256, "most": 1024, "strict": 9, "lax": 6}


def test_store_release_collect_restore(spark):
    r = np.random.default_rng(2)
    a, b = r.integers(0, 256, 9000, dtype=np.uint8).tobytes(), r.integers(0, 256, 3000, dtype=np.uint8).tobytes()
    b += a[2000:]
    contents = spark.createDataFrame([(a,), (b,), (a,), (b"",)], "content binary")
    blank, nothing = spark.createDataFrame([], "hash string, size long, refcount long"), spark.createDataFrame([], "file_hash string, idx int, chunk_hash string")
    made = vault.store(contents, blank, blank, nothing, blank, **BOUNDS)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert dict(rows(made["files"], "hash", "refcount")) == {sha(a): 2, sha(b): 1, sha(b""): 1}
    assert vault.wrong_refcounts(made["chunks"], made["file_chunks"]).isEmpty()
    assert made["chunks"].count() < len(vault.cut_points(a, **BOUNDS)) + len(vault.cut_points(b, **BOUNDS))
    asked = spark.createDataFrame([(sha(a),), (sha(b),), ("f" * 64,), (sha(b""),)], "hash string")
    got = {r["hash"]: r for r in vault.restore(made["files"], made["file_chunks"], made["chunk_data"], asked).collect()}
    assert bytes(got[sha(a)]["content"]) == a and bytes(got[sha(b)]["content"]) == b and got["f" * 64]["state"] == "missing" and bytes(got[sha(b"")]["content"]) == b""
    spoilt = made["chunk_data"].withColumn("content", F.when(F.col("hash") == made["file_chunks"].where(F.col("file_hash") == sha(b)).first()["chunk_hash"], F.lit(b"?")).otherwise(F.col("content")))
    assert vault.restore(made["files"], made["file_chunks"], spoilt, asked).where(F.col("hash") == sha(b)).first()["state"] == "corrupt"
    once = vault.release(made["files"], made["chunks"], made["file_chunks"], spark.createDataFrame([(sha(a),), (sha(b),)], "hash string"))
    assert dict(rows(once["files"], "hash", "refcount")) == {sha(a): 1, sha(b""): 1}
    assert vault.wrong_refcounts(once["chunks"].where("refcount > 0"), once["file_chunks"]).isEmpty()
    kept, doomed, stats = vault.collect_garbage(once["chunks"], spark.createDataFrame([("stray", 5)], "hash string, size long"))
    assert doomed.count() == stats.first()["chunks"] == once["chunks"].where("refcount = 0").count() + 1 and kept.where("refcount = 0").isEmpty()
    again = vault.store(spark.createDataFrame([(a,)], "content binary"), once["files"], once["chunks"], once["file_chunks"], made["chunk_data"], **BOUNDS)
    assert dict(rows(again["files"], "hash", "refcount"))[sha(a)] == 2 and again["chunk_data"].isEmpty() and again["file_chunks"].count() == once["file_chunks"].count()


# --- grouping --------------------------------------------------------------------------


def plain_clusters(edges, together, apart, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def unite(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for a, b in together:
        unite(a, b)
    refused = 0
    for _, a, b in sorted((-s, a, b) for a, b, s in edges if (a, b) not in together):
        p, q = find(a), find(b)
        if p == q:
            continue
        if any({find(x), find(y)} == {p, q} for x, y in apart):
            refused += 1
        else:
            unite(a, b)
    return {n: find(n) for n in nodes}, refused


@pytest.mark.parametrize("seed", range(30))
def test_ordered_union_equals_the_plain_one(seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    pairs = list(itertools.combinations(nodes, 2))
    edges = [(a, b, r.choice([0.7, 0.8, 0.9, 1.0])) for a, b in r.sample(pairs, 14)]
    some = r.sample(pairs, 5)
    together, apart = set(some[:2]), set(some[2:])
    number = {x: i for i, x in enumerate(nodes)}
    ints = lambda ps: np.array([(number[x], number[y]) for x, y in ps], np.int64).reshape(-1, 2)
    ordered = [(x, y) for _, x, y in sorted((-s, x, y) for x, y, s in edges if (x, y) not in together)]
    got = grouping.ordered_union(len(nodes), ints(ordered), ints(sorted(apart)), ints(sorted(together)))
    want, refused = plain_clusters(edges, together, apart, nodes)
    assert [nodes[i] for i in got] == [want[x] for x in nodes]
    assert sum(got[number[x]] != got[number[y]] for x, y in ordered) == refused


def union_of(files, listed, apart, together, w):
    """nearest_union() of files (name, microseconds, pictured) with the listed pairs {(i, j): total} of two pictures."""
    names = sorted({f[0] for f in files})
    near = [(a, b, s) for a in range(len(names)) for b in range(len(names)) if (s := 1.0 if a == b else 0.86 if (a + b) % 2 else 0.72) and (a == b or (a + b) % 3)]
    ints = lambda ps: np.array(sorted(ps), np.int64).reshape(-1, 2)
    edges = sorted(listed, key=lambda p: (-listed[p], p))
    flat = w.time_window_s <= 0 or not w.time
    at = np.array([0 if flat else f[1] for f in files], np.int64)
    got, refused = unions.nearest_union(
        np.array([names.index(f[0]) for f in files], np.int64), at, np.array([f[2] for f in files], bool), tuple(np.array(c) for c in zip(*near, strict=True)), grouping._plain_total(w),
        lambda s: grouping._widest(s, w, -1), w.threshold, int(w.time_window_s * 1e6), np.array(edges, np.int64).reshape(-1, 2), np.array([listed[p] for p in edges], float), ints(apart), ints(together),
    )
    plain = grouping._plain_total(w)
    scores = {(a, b): s for a, b, s in near}
    every = dict(listed)
    for i, j in itertools.combinations(range(len(files)), 2) if len(files) < 1000 else ():
        if not (files[i][2] and files[j][2]) and (s := scores.get((names.index(files[i][0]), names.index(files[j][0])))):
            if (total := float(plain(np.array([s]), np.array([abs(at[i] - at[j])]))[0])) >= w.threshold:
                every[i, j] = total
    return got.tolist(), refused, [(i, j, s) for (i, j), s in every.items()]


@pytest.mark.parametrize("seed", range(60))
def test_nearest_union_equals_the_plain_one(seed):
    """Few and many names, instants, pictures and decisions, and weights that make times count, count little or not at all."""
    r = random.Random(seed)
    w = grouping.Weights(time=r.choice([0.1, 0.1, 0.4, 0.0]), time_window_s=r.choice([8 * 3600, 1200, 0]), threshold=r.choice([0.62, 0.75]))
    files = [(f"n{r.randrange(r.choice([1, 3, 8]))}", r.randrange(r.choice([2, 30, 3000])) * 60_000_000, r.random() < r.choice([0.0, 0.4])) for _ in range(r.choice([2, 25, 70]))]
    pairs = list(itertools.combinations(range(len(files)), 2))
    listed = {p: r.choice([0.7, 0.8, 0.875, 0.9, 1.0]) for p in pairs if files[p[0]][2] and files[p[1]][2] and r.random() < 0.5}
    some = r.sample(pairs, min(len(pairs), r.choice([1, 6, 40])))
    together = {p for p in some if r.random() < 0.3}
    got, refused, every = union_of(files, {p: s for p, s in listed.items() if p not in together}, set(some) - together, together, w)
    want, want_refused = plain_clusters(every, together, set(some) - together, range(len(files)))
    assert got == [want[i] for i in range(len(files))] and refused == want_refused


@pytest.mark.parametrize("seed", range(60))
def test_nearest_union_finds_links_of_pictures(monkeypatch, seed):
    """Pairs of two pictures aren't listed, but those that only folder trees link; few and many looks, twins, and decisions."""
    r = random.Random(seed)
    monkeypatch.setattr(unions, "_STEPS", r.choice([0, 1, 16]))
    w = grouping.Weights(time=r.choice([0.1, 0.1, 0.4, 0.0]), time_window_s=r.choice([8 * 3600, 1200, 0]), threshold=r.choice([0.62, 0.75]))
    bases = [r.getrandbits(64) for _ in range(r.choice([1, 3]))]
    spread, names, instants = r.choice([(0,), (0, 5, 15, 24, 30)]), r.choice([1, 3, 8]), r.choice([2, 30, 3000])
    looks = [r.choice(bases) ^ sum(1 << b for b in r.sample(range(64), r.choice(spread))) for _ in range(12)]
    flat = w.time_window_s <= 0 or not w.time
    files = [(r.randrange(names), 0 if flat else r.randrange(instants) * 60_000_000, r.choice(looks) if r.random() < 0.6 else None) for _ in range(r.choice([2, 25, 90]))]
    score = lambda a, b: 1.0 if a == b else 0.0 if not (a + b) % 3 else 0.86 if (a + b) % 2 else 0.72
    every, listed = {}, {}
    for (i, a), (j, b) in itertools.combinations(enumerate(files), 2):
        if not (s := score(a[0], b[0])):
            continue
        near = 0.0 if w.time_window_s <= 0 else max(0.0, 1 - abs(a[1] - b[1]) / (w.time_window_s * 1e6))
        if a[2] is None or b[2] is None:
            total = (w.name * s + w.time * near) / (w.name + w.time)
        else:
            d = (a[2] ^ b[2]).bit_count()
            total = w.name * s + w.time * near + w.image * (1.0 if d <= 10 else 0.0 if d >= 26 else 1 - (d - 10) / 16)
            if d > 26:
                if s == 1.0 and total >= w.threshold and r.random() < 0.3:
                    listed[i, j] = total
                total = listed.get((i, j), 0.0)
        if total >= w.threshold:
            every[i, j] = total
    pairs = list(itertools.combinations(range(len(files)), 2))
    some = r.sample(pairs, min(len(pairs), r.choice([1, 6, 60])))
    together = {p for p in some if r.random() < 0.3}
    apart = set(some) - together
    edges = sorted((p for p in listed if p not in together), key=lambda p: (-listed[p], p))
    ints = lambda ps: np.array(sorted(ps), np.int64).reshape(-1, 2)
    name, at = np.array([f[0] for f in files], np.int64), np.array([f[1] for f in files], np.int64)
    seen = np.array([f[2] is not None for f in files])
    similar = tuple(np.array(c) for c in zip(*((a, b, score(a, b)) for a in range(names) for b in range(names) if score(a, b)), strict=True))
    bits = np.array([f[2] or 0 for f in files], np.uint64).view(np.int64)
    got, refused = unions.nearest_union(
        name, at, seen, similar, grouping._plain_total(w), lambda s: grouping._widest(s, w, -1), w.threshold, int(w.time_window_s * 1e6), np.array(edges, np.int64).reshape(-1, 2),
        np.array([listed[p] for p in edges], float), ints(apart), ints(together), grouping._similar_looks(name, bits, seen, similar, w),
    )
    want, want_refused = plain_clusters([(i, j, s) for (i, j), s in every.items()], together, apart, range(len(files)))
    assert got.tolist() == [want[i] for i in range(len(files))] and refused == want_refused


def test_many_files_of_one_name_with_decisions_make_no_pairs():
    """40,000 files, 800 million links: each two of 50 files in a row of time are kept apart."""
    n = 40_000
    files = [("poster", (i * 7919 % n) * 60_000_000, i % 4 == 0) for i in range(n)]
    inverse = {i * 7919 % n: i for i in range(n)}
    apart = {tuple(sorted((inverse[k], inverse[k + 50]))) for k in range(0, 20_000, 500)}
    got, refused, _ = union_of(files, {}, apart, set(), grouping.Weights())
    label = np.array(got)
    assert all(label[a] != label[b] for a, b in apart)
    seen = np.arange(n) % 4 == 0
    links = lambda i: len(i) * (len(i) - 1) // 2 - seen[i].sum() * (seen[i].sum() - 1) // 2
    assert refused == links(np.arange(n)) - sum(links(np.flatnonzero(label == k)) for k in np.unique(label))


def plain_total(a, b, w):
    """The score of two files (path, name, minutes, bits), written out."""
    longest = max(len(a[1]), len(b[1]))
    row = list(range(len(b[1]) + 1))
    for i, x in enumerate(a[1], 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b[1], 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    name = 1.0 if a[1] == b[1] else 0.0 if not a[1] or not b[1] else max(0.0, 1 - row[-1] / longest)
    close = max(0.0, 1 - abs(a[2] - b[2]) / 480)
    if a[3] is None or b[3] is None:
        return (w.name * name + w.time * close) / (w.name + w.time)
    d = bin((a[3] ^ b[3]) & (1 << 64) - 1).count("1")
    folders = [x[0].rsplit("/", 1)[0] for x in (a, b)]
    tree = any(x == y or x.startswith(y + "/") for x, y in (folders, folders[::-1]))
    if d > w.different_image and not (a[1] == b[1] and tree):
        return 0.0
    return w.name * name + w.time * close + w.image * (1.0 if d <= 10 else 0.0 if d >= 26 else 1 - (d - 10) / 16)


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_all_pairs(spark, seed):
    """Files of similar and equal names, with and without pictures, near and far in time, with and without decisions."""
    r, w = random.Random(seed), grouping.Weights()
    names = ["poster kampus", "poster kampua", "poster kamp", "postre kompus", "logo kopi", "logo kopo", "logo", "undangan nikah ani", "undangan nikah budi"]
    base = [r.getrandbits(64) for _ in range(3)]
    files = []
    for i in range(90):
        bits = None if r.random() < 0.6 else base[r.randrange(3)] ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 5, 15, 24, 30])))
        files.append((f"/w/{r.randrange(4)}/{'x/' * r.randrange(2)}f{i:02}.psd", r.choice(names), r.randrange(0, 6000), bits))
    pairs = [(a, b) if a[0] < b[0] else (b, a) for a, b in itertools.combinations(files, 2)]
    decided = {p: d for p, d in zip(r.sample([(a[0], b[0]) for a, b in pairs], 10 * seed), itertools.cycle(["apart", "together", "apart"]))}
    edges = [(a[0], b[0], t) for a, b in pairs if (t := plain_total(a, b, w)) >= w.threshold]
    want, refused = plain_clusters(edges, {p for p, d in decided.items() if d == "together"}, {p for p, d in decided.items() if d == "apart"}, [f[0] for f in files])
    signed = lambda v: None if v is None else v - (1 << 64) if v >> 63 else v
    cands = spark.createDataFrame([(p, 1, n, at(0) + dt.timedelta(minutes=m), signed(b)) for p, n, m, b in files], "path string, asset_id long, name string, modified_at timestamp_ntz, bits long")
    decisions = spark.createDataFrame([(a, b, d) for (a, b), d in decided.items()], "path_a string, path_b string, decision string")
    got = grouping.clusters(cands, decisions).collect()
    assert {x["path"]: x["cluster"] for x in got} == want and len(got) == len(files)
    assert sum(x["refused"] for x in got) == refused


def test_clusters_of_pictures_list_no_pairs(spark, monkeypatch):
    """300 files of one picture at three instants, of which the second's join the third's as two files are kept apart."""
    rows = [(f"/w/f{i:03}.psd", 1, "poster", at(0) + dt.timedelta(minutes=i % 3), 5) for i in range(300)]
    cands = spark.createDataFrame(rows, "path string, asset_id long, name string, modified_at timestamp_ntz, bits long")
    decisions = spark.createDataFrame([("/w/f000.psd", "/w/f001.psd", "apart")], "path_a string, path_b string, decision string")
    monkeypatch.delattr(grouping, "_pairs")
    got = grouping.clusters(cands, decisions).collect()
    assert all(x["cluster"] == ("/w/f000.psd" if int(x["path"][4:7]) % 3 == 0 else "/w/f001.psd") for x in got) and len(got) == 300
    assert sum(x["refused"] for x in got) == 100 * 200


SEVEN = ["poster-kampus.psd", "poster kampus final.psd", "poster_kampus_fix.psd", "poster kampus revisi 3.psd", "Poster Kampus FINAL ASLI.psd", "poster_kampus_v2 (1).psd", "poster-kampus-20260909.psd"]


def scattered(make):
    paths = [f"/w/{n}" for n in SEVEN] + ["/w/logo kopi.png", "/w/x/undangan.psd"]
    return make(assets=[(i + 1, p, at(0), at(0)) for i, p in enumerate(paths)], versions=[version(i + 1, i + 1, f"h{i}", path=p) for i, p in enumerate(paths)], observed_files=[tracked(p, i + 1, f"h{i}") for i, p in enumerate(paths)])


def test_seven_names_become_one_work(make):
    after, counts = grouping.regroup(scattered(make), now=lit(at(9)))
    assert dict(rows(after.observed_files, "path", "asset_id")) == {**{f"/w/{n}": 1 for n in SEVEN}, "/w/logo kopi.png": 8, "/w/x/undangan.psd": 9}
    assert rows(after.assets, "id") == [(1,), (8,), (9,)] and counts["moved"] == 6 and counts["removed"] == 6 and after.generation == 2
    assert {r["asset_id"] for r in after.versions.collect()} == {1, 8, 9}


def test_split_survives_regrouping_and_merge_undoes_it(make):
    c, _ = grouping.regroup(scattered(make), now=lit(at(9)))
    # the kept file comes first in path order, so the others join it again; two clusters of one work would stay in it
    a, b = f"/w/{SEVEN[4]}", f"/w/{SEVEN[1]}"
    c = grouping.split(c, a, b, lit(at(10)))
    assert dict(rows(c.observed_files, "path", "asset_id"))[b] == 10
    c, counts = grouping.regroup(c, now=lit(at(11)))
    of = dict(rows(c.observed_files, "path", "asset_id"))
    assert of[a] != of[b] and counts["refused"] > 0
    c = grouping.merge(c, a, b, lit(at(12)))
    c, _ = grouping.regroup(c, now=lit(at(13)))
    assert len({of for p, of in rows(c.observed_files, "path", "asset_id") if p.startswith("/w/poster") or p.startswith("/w/Poster")}) == 1


def test_detach_is_apart_from_all(make):
    c, _ = grouping.regroup(scattered(make), now=lit(at(9)))
    path = f"/w/{SEVEN[3]}"
    after = grouping.detach(c, path, lit(at(10)))
    assert after.grouping_decisions.count() == 6 and grouping.detach(after, path, lit(at(11))) is after
    again, _ = grouping.regroup(after, now=lit(at(12)))
    of = dict(rows(again.observed_files, "path", "asset_id"))
    assert sum(v == of[path] for v in of.values()) == 1


def test_scores_and_reasons(make, spark):
    bits = lambda n: (((1 << n) - 1) << (64 - n)).to_bytes(8, "big").hex()
    files = [("/k/logo.png", 0, ""), ("/k/logo final.png", 1 / 3, ""), ("/k/b/logo.png", 9, ""), ("/x/logo.png", 0, bits(0)), ("/x/logo_v2.png", 0, bits(8)), ("/y/logo.png", 0, bits(44)), ("/x/logo fix.png", 2, bits(44))]
    c = make(observed_files=[tracked(p, i + 1, f"h{i}", t) for i, (p, t, _) in enumerate(files)], previews=[(f"h{i}", "ok", "image", 1, 1, 1, at(0), "", "png", False, h) for i, (_, _, h) in enumerate(files) if h])
    ask = spark.createDataFrame([("/k/logo.png", "/k/logo final.png"), ("/k/logo.png", "/k/b/logo.png"), ("/x/logo.png", "/x/logo_v2.png"), ("/x/logo.png", "/y/logo.png"), ("/x/logo.png", "/x/logo fix.png")], "path_a string, path_b string")
    got = {(r["path_a"], r["path_b"]): r for r in grouping.explain(c, ask).collect()}
    total = [got[tuple(r)]["total"] for r in ask.collect()]
    assert total == pytest.approx([(0.7 + 0.1 * (1 - 20 / 480)) / 0.8, 0.875, 1.0, 0.0, 0.7 + 0.1 * 0.75])
    assert [got[tuple(r)]["grouped"] for r in ask.collect()] == [True, True, True, False, True]
    veto = got["/x/logo.png", "/y/logo.png"]
    assert veto["vetoed"] and veto["reason"] == 'gambarnya terlalu jauh berbeda (jarak 44) untuk mempercayai kemiripan namanya; namanya sama ("logo") tapi foldernya tidak berhubungan (/x dan /y)'


def test_scheduler_waits_for_quiet():
    clock, runs = [0.0], []
    s = grouping.Scheduler(lambda: runs.append(clock[0]), 30, lambda: clock[0])
    assert not s.notice(False) and not s.notice(True) and s.pending() and s.notice(False) and runs == [0.0]
    s.notice(True)
    clock[0] = 29
    assert not s.notice(False)
    clock[0] = 30
    assert s.notice(False) and runs == [0.0, 30]

    def fail():
        raise RuntimeError

    s = grouping.Scheduler(fail, 0, lambda: clock[0])
    s.notice(True)
    with pytest.raises(RuntimeError):
        s.notice(False)
    assert s.pending()


# --- ingest --------------------------------------------------------------------------------


def test_a_scan_is_classified_and_applied(make, spark):
    c = make(
        assets=[(1, "a", at(0), at(0)), (2, "b", at(0), at(0))], versions=[version(1, 1, "h1", path="/w/a.psd"), version(2, 2, "h2", path="/w/b.psd")], observed_files=[tracked("/w/a.psd", 1, "h1"), tracked("/w/b.psd", 2, "h2")],
        tickets=[(1, 1, "waiting_on_me", "open", "n", "w", at(0), None, None)], grouping_decisions=[("/w/a.psd", "/w/b.psd", "apart", at(0))],
    )
    read = spark.createDataFrame([("/w/a.psd", 11, at(5), "h9", True), ("/w/c.psd", 10, at(5), "h2", True), ("/w/d.psd", 7, at(5), "h7", True), ("/w/e.psd", 7, at(5), "h8", False)], "path string, size long, mtime timestamp, file_hash string, still_same boolean")
    got = ingest.classify(read, c.observed_files, read.select("path", "size", "mtime"))
    assert rows(got, "path", "outcome", "asset_id") == [("/w/a.psd", "new_version", 1), ("/w/c.psd", "renamed", 2), ("/w/d.psd", "new_asset", None), ("/w/e.psd", "moved", None)]
    after = ingest.apply_outcomes(c, got, lit(at(6)))
    assert rows(after.observed_files, "path", "asset_id", "last_hash") == [("/w/a.psd", 1, "h9"), ("/w/c.psd", 2, "h2"), ("/w/d.psd", 3, "h7")]
    assert rows(after.assets, "id", "name", "updated_at") == [(1, "a", at(6)), (2, "c.psd", at(6)), (3, "d.psd", at(6))]
    assert rows(after.versions, "asset_id", "file_key", "file_hash") == [(1, "/w/a.psd", "h1"), (1, "/w/a.psd", "h9"), (2, "/w/c.psd", "h2"), (3, "/w/d.psd", "h7")]
    assert rows(after.tickets, "status", "flagged_at") == [("maybe_done", at(6))] and rows(after.grouping_decisions, "path_a", "path_b") == [("/w/a.psd", "/w/c.psd")]
    same = ingest.classify(read.limit(1).withColumn("file_hash", F.lit("h1")), c.observed_files, read)
    assert rows(same, "outcome") == [("verified",)]


def test_gap_of_exactly_the_quiet_time_settles(spark):
    seen = spark.createDataFrame([("p", 1, at(0), T0 + dt.timedelta(seconds=s), "free") for s in (0, 2, 5, 7, 9)], TABLES["sightings"])
    assert rows(ingest.settled_saves(seen, 3), "n") == [(2,), (3,)]
    assert rows(ingest.settled_saves(seen), "n") == [(2,), (3,)]


def test_problems_need_five_tries(spark):
    states = [("a", "unknown", i) for i in range(5)] + [("b", "unknown", i) for i in range(4)] + [("c", "unknown", 0), ("c", "free", 3), *[("c", "unknown", i) for i in range(4, 8)]] + [("d", "locked", i) for i in range(9)]
    assert rows(ingest.problems(spark.createDataFrame(states, "path string, state string, at long"))) == [("a", 5)]


def test_scans_follow_files_from_first_sight_to_forgetting(spark, make):
    c, hashes, states = make(observed_files=[tracked("/w/old.psd", 1, "h0")], assets=[(1, "old", at(0), at(0))], versions=[version(1, 1, "h0", path="/w/old.psd")]), {}, {}
    state, roots = spark.createDataFrame([], ingest.SCAN_STATE), spark.createDataFrame([("/w/",)], "path string")
    opened = []

    def read(files):
        got = [(*r, hashes.get(r[0], "h-" + r[0]), states.get(r[0], "free") != "moved", states.get(r[0], "free").replace("moved", "free")) for r in rows(files, "path", "size", "mtime")]
        opened.append([r[0] for r in got])
        return spark.createDataFrame(got, "path string, size long, mtime timestamp, file_hash string, still_same boolean, open_state string")

    def scan(seconds, **files):
        nonlocal c, state
        listing = spark.createDataFrame([(f"/w/{n}.psd", size, at(0)) for n, size in files.items()], "path string, size long, mtime timestamp")
        got = ingest.scan(c, state, listing, roots, read, lit(at(20) + dt.timedelta(seconds=seconds)), IngestConfig(open_attempts=2))
        now_local = lambda df: spark.createDataFrame(df.collect(), df.schema)
        c, state = Catalogue(**{k: now_local(v) if k in ("assets", "versions", "observed_files", "grouping_decisions", "tickets") else v for k, v in got.catalogue.__dict__.items()}), now_local(got.state)
        n = got.counters.first().asDict()
        return {k: v for k, v in n.items() if v}, rows(got.problems)

    assert scan(0, a=5, b=7) == ({"waiting": 2}, []) and opened == [[]]  # first sight, and the old file begins to be missing
    states |= {"/w/a.psd": "moved", "/w/b.psd": "unknown"}
    hashes["/w/new.psd"] = "h0"
    assert scan(3, a=5, b=8, new=9) == ({"waiting": 3, "vanished": 1, "changed": True}, []) and opened[-1] == ["/w/a.psd"]  # b changed
    states["/w/a.psd"] = "free"
    assert scan(6, a=5, b=8, new=9) == ({"waiting": 2, "settled": 1, "new_versions": 1, "new_assets": 1, "changed": True}, [])  # new: nothing left to be a rename of; a starts over, b fails once
    assert scan(9, a=5, b=8, new=9) == ({"unreadable": 1, "settled": 2, "new_versions": 1, "new_assets": 1, "changed": True}, [("/w/b.psd", 2)])
    assert scan(12, a=5, b=8, new=9) == ({"unreadable": 1, "settled": 2}, [("/w/b.psd", 2)]) and opened[-1] == []
    hashes["/w/moved.psd"] = "h-/w/a.psd"
    states.clear()
    assert scan(14, b=9, new=9, moved=5) == ({"settled": 1, "waiting": 2}, [])  # b changed, so it is tried again
    assert scan(17, b=9, new=9, moved=5)[0] == {"settled": 3, "new_versions": 1, "new_assets": 1, "renamed": 1, "changed": True}
    assert rows(c.observed_files, "path", "last_hash") == [("/w/b.psd", "h-/w/b.psd"), ("/w/moved.psd", "h-/w/a.psd"), ("/w/new.psd", "h0")]
    assert scan(3600 + 17, b=9, new=9, moved=5)[0] == {"settled": 3, "verified": 3}
    assert state.count() == 3


def test_listing_leaves_noise_out(spark, tmp_path):
    for name in ("a.psd", "sub/b.png", "sub/~$b.png", "x.tmp", ".git/config", "node_modules/y.js"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"data")
    got = folders.listing(spark, [str(tmp_path), str(tmp_path / "sub")], content=True, most_bytes=100)
    assert [p.removeprefix(str(tmp_path)) for p, *_ in rows(got)] == ["/a.psd", "/sub/b.png"] and got.columns == ["path", "size", "mtime", "content"]


# --- pictures ---------------------------------------------------------------------------------


def picture(h, w, seed=0, alpha=False):
    p = np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)
    if not alpha:
        p[..., 3] = 255
    return p


@pytest.mark.parametrize("alpha", [False, True])
def test_png_round_trip(alpha):
    p = picture(13, 7, alpha=alpha)
    assert (previews.decode_png(previews.encode_png(p)) == p).all()


def test_png_filters_undo():
    lines = picture(5, 6)[..., :3]
    out, above = [], np.zeros((6, 3), int)
    kinds = [0, 1, 2, 3, 4]
    for k, row in zip(kinds, lines.astype(int), strict=True):
        left = np.concatenate([np.zeros((1, 3), int), row[:-1]])
        corner = np.concatenate([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * row, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][k]
        out.append((row - guess) & 255)
        above = row
    assert (previews._unfiltered(np.array(kinds), np.array(out).astype(np.uint8)) == lines).all()


def as_png(w, h, depth, kind, lines, lace=0, extra=b""):
    piece = lambda name, data: len(data).to_bytes(4, "big") + name + data + b"crc."
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([depth, kind, 0, 0, lace])
    return previews.PNG_MARK + piece(b"IHDR", head) + extra + piece(b"IDAT", zlib.compress(lines)) + piece(b"IEND", b"")


def test_png_of_every_depth():
    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + b"crc."
    grey = lambda *a, **k: previews.decode_png(as_png(*a, **k))[..., 0].tolist()
    assert grey(3, 2, 1, 0, b"\0\xa0\0\x40") == [[255, 0, 255], [0, 255, 0]]
    assert grey(3, 1, 2, 0, b"\0\x1b") == [[0, 85, 170]] and grey(3, 1, 4, 0, b"\0\x0f\x80") == [[0, 255, 136]]
    wide = previews.decode_png(as_png(2, 1, 16, 6, b"\1" + bytes([1, 2, 3, 4, 5, 6, 7, 8]) + bytes([1, 0, 1, 0, 1, 0, 1, 0])))
    assert wide.tolist() == [[[1, 3, 5, 7], [2, 4, 6, 8]]]
    dull = previews.decode_png(as_png(2, 1, 16, 0, b"\0\x12\x34\x12\x35", extra=chunk(b"tRNS", b"\x12\x34")))
    assert dull.tolist() == [[[18, 18, 18, 0], [18, 18, 18, 255]]]
    key = previews.decode_png(as_png(2, 1, 8, 2, b"\0\1\2\3\1\2\4", extra=chunk(b"tRNS", b"\0\1\0\2\0\3")))
    assert key[..., 3].tolist() == [[0, 255]]
    table = previews.decode_png(as_png(4, 1, 2, 3, b"\0\x1b", extra=chunk(b"PLTE", b"abcdef") + chunk(b"tRNS", b"\7")))
    assert table.tolist() == [[[97, 98, 99, 7], [100, 101, 102, 255], [0, 0, 0, 255], [0, 0, 0, 255]]]
    for bad in (as_png(2, 1, 8, 2, b"\0\1\2\3\1\2\4", extra=chunk(b"tRNS", b"\0")), as_png(4, 1, 2, 3, b"\0\x1b"), as_png(3, 2, 8, 0, b"\5abc\0abc"), as_png(3, 2, 8, 0, b"\0abc")):
        with pytest.raises(previews.Broken):
            previews.decode_png(bad)
    for odd in (as_png(1, 1, 16, 3, b"\0\0\0"), as_png(1, 1, 3, 0, b"\0\0"), as_png(1, 1, 8, 5, b"\0\0")):
        with pytest.raises(previews.Unsupported):
            previews.decode_png(odd)


@pytest.mark.parametrize("h,w", [(13, 11), (1, 1), (2, 9), (8, 8), (5, 3)])
def test_png_in_seven_passes(h, w):
    p = picture(h, w, alpha=True)
    order = [[1, 6, 4, 6, 2, 6, 4, 6], [7] * 8, [5, 6, 5, 6, 5, 6, 5, 6], [7] * 8, [3, 6, 4, 6, 3, 6, 4, 6], [7] * 8, [5, 6, 5, 6, 5, 6, 5, 6], [7] * 8]
    lines = b""
    for k in range(1, 8):
        for y in range(h):
            part = [p[y, x].tobytes() for x in range(w) if order[y % 8][x % 8] == k]
            lines += b"\0" + b"".join(part) if part else b""
    assert (previews.decode_png(as_png(w, h, 8, 6, lines, lace=1)) == p).all()


def test_png_filters_undo_over_bands():
    r = np.random.default_rng(5)
    kinds, lines = r.integers(0, 5, 600), r.integers(0, 256, (600, 9, 3), dtype=np.uint8)
    lines[300:, :, :] &= 1
    got, above = previews._unfiltered(kinds, lines).astype(int), np.zeros((9, 3), int)
    for kind, line, row in zip(kinds, lines.astype(int), got, strict=True):
        left, corner = (np.concatenate([np.zeros((1, 3), int), v[:-1]]) for v in (row, above))
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * row, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][kind]
        assert (row == (line + guess) & 255).all()
        above = row


def test_hash_of_scaled_pictures_is_stable():
    y, x = np.mgrid[:128, :128]
    p = np.full((128, 128, 4), 255, np.uint8)
    p[..., :3] = (127 + 120 * np.sin(x / 17 + y / 29))[..., None].astype(np.uint8)
    small = previews.scale_to_fit(p, 64)
    assert small.shape == (64, 64, 4) and bin(int(previews.phash(p), 16) ^ int(previews.phash(small), 16)).count("1") <= 2
    assert previews.phash(np.full((8, 8, 4), 255, np.uint8)) == "ff" * 8
    q = p.copy()
    q[:64] = 0
    q[..., 3] = 255
    assert previews.phash(q) == "00000000ffffffff" or previews.phash(q).startswith("00000000")


def test_previews_of_each_kind(spark):
    png = previews.encode_png(picture(20, 30))
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("maindoc.xml", "x")
        z.writestr("MergedImage.png", png)
    psd = b"8BPS" + (1).to_bytes(2, "big") + bytes(6) + (3).to_bytes(2, "big") + (2).to_bytes(4, "big") + (2).to_bytes(4, "big") + (8).to_bytes(2, "big") + (3).to_bytes(2, "big") + bytes(12)
    raw, packed = psd + bytes(2) + bytes(range(12)), psd + b"\0\1" + b"\0\2" * 6 + b"\xff\x07" * 6
    files = [("1", "/w/a.PNG", png), ("2", "/w/a.kra", box.getvalue()), ("3", "/w/a.psd", raw), ("4", "/w/a.psd", packed), ("5", "/w/a.psd", raw[:-3]), ("6", "/w/a.mp4", b"x"), ("7", "/w/a.png", png[:60]), ("8", "/w/a.kra", b"no zip"), ("9", "/w/a.psd", b"8BPS" + (2).to_bytes(2, "big")), ("10", "/w/old.png", png), ("1", "/w/b.png", png)]
    old = spark.createDataFrame([("10",)], "file_hash string")
    got = {r["file_hash"]: r for r in previews.generate(spark.createDataFrame(files, "file_hash string, path string, content binary"), old).collect()}
    assert {h: (r["status"], r["source"]) for h, r in got.items()} == {"1": ("ok", "image"), "2": ("ok", "kra"), "3": ("ok", "psd"), "4": ("ok", "psd"), "5": ("failed", "psd"), "6": ("unsupported", "video"), "7": ("failed", "image"), "8": ("failed", "kra"), "9": ("unsupported", "psd")}
    assert (got["1"]["width"], got["1"]["height"], got["1"]["format"]) == (30, 20, "png") and got["1"]["phash"] == got["2"]["phash"] == previews.phash(picture(20, 30))
    assert (previews.decode_psd(packed)[..., :3] == 7).all()
    thumbs = spark.createDataFrame([(r["file_hash"], "png", r["data"]) for r in got.values() if r["data"]] + [("x", "png", b"?")], TABLES["thumbs"])
    assert dict(rows(previews.hash_thumbnails(thumbs))) == {h: r["phash"] for h, r in got.items() if r["phash"]}


def test_sizes_fit():
    assert [previews.fit_within(*x, 512) for x in ((0, 5), (100, 50), (1024, 512), (512, 2048), (9000, 1))] == [(0, 0), (100, 50), (512, 256), (128, 512), (512, 1)]
    assert previews.unpack_bits(b"\x02abc\xffz\x80", 6) == b"abczz\xff"
    with pytest.raises(previews.Broken):
        previews.unpack_bits(b"\xff", 3)


def test_wide_alpha_is_flattened_in_the_budget():
    from folio.schema import PreviewLimits

    data, w, h, flat = previews.thumbnail(picture(64, 64, alpha=True), PreviewLimits(png_bytes=100))
    assert flat and (w, h) == (64, 64) and (previews.decode_png(data)[..., 3] == 255).all()


# --- retention and tables ------------------------------------------------------------------------


def test_thinning_keeps_what_is_immune(make):
    day = 24
    c = make(versions=[version(1, 1, "a", 0), version(2, 1, "b", 1), version(3, 1, "c", 2, pinned=True), version(4, 1, "d", 3), version(5, 1, "e", 40 * day), version(6, 1, "f", 0, present=False)], tickets=[(1, 1, "waiting_on_me", "open", "n", "w", at(0), None, None)])
    got = dict(rows(retention.thinned(c, lit(at(41 * day))), "id", "keep"))
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert rows(retention.releasable(c, lit(at(41 * day)))) == [("b",)]


def test_tables_round_trip(make, spark, tmp_path):
    c = scattered(make)
    base = str(tmp_path)
    assert tables.current(spark, base) == 0 and tables.load(spark, base).assets.isEmpty()
    assert tables.save(c, base, 0) == 1
    assert rows(tables.load(spark, base).versions) == rows(c.versions)
    with pytest.raises(changes.Stale):
        tables.save(c, base, 0)


# --- streams ----------------------------------------------------------------------------------------


def test_debounce_stream(spark, tmp_path):
    debounce.needs(spark)
    second = lambda s: T0 + dt.timedelta(seconds=s)
    seen = [("a", 1, at(0), second(0)), ("a", 1, at(0), second(2)), ("a", 1, at(0), second(3)), ("a", 1, at(0), second(9)), ("b", 1, at(0), second(0)), ("b", 2, at(0), second(2)), ("b", 2, at(0), second(4)), ("c", 1, at(0), second(0))]
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([(*x, "free") for x in seen], TABLES["sightings"]).coalesce(1).write.parquet(source)
    stream = debounce.settled(debounce.sightings_stream(spark, source), IngestConfig())
    finished = []
    q = debounce.watch(stream, lambda batch, n: out.extend(rows(batch)), str(tmp_path / "ck"), finished.append, available_now=True)
    q.awaitTermination(120)
    assert out == [("a", 1, at(0), second(3))] and finished
