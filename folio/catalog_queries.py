"""Queries over the version catalogue (folio.sources.testdata) and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import similarity, text
from folio.operators import catalogue as cat
from folio.operators import changes, grouping, ingest, retention, vault
from folio.plans.components import materialize
from folio.plans.pairs import paired
from folio.schema import Catalogue
from folio.sources import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ASSET, PREFIX = 7, "/work/7/"


def now() -> Column:
    return F.lit(td.NOW).cast("timestamp_ntz")


def query(sql: str | None = None):
    """Register a function of the catalogue; its SQL stands on the same views."""

    def register(f: Callable[[Catalogue], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(td.catalogue(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = f"{td.SQL_VIEWS}\n{sql}"
        return f

    return register


def on_tables(sql: str | None = None, views: bool = True):
    """Register a function of (spark, sf_dir)."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"{td.SQL_VIEWS}\n{sql}" if views else sql
        return f

    return register


# --- works, versions, pictures ----------------------------------------------

_LATEST = "(SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY observed_at DESC, id DESC) = 1)"
_THUMB = "CASE WHEN {0} = 'ok' AND file_hash <> '' THEN '/thumb/' || file_hash ELSE '' END"


@query(f"""
SELECT a.id, a.name, a.updated_at, v.id AS version_id, v.file_hash, v.observed_at, coalesce(nv.n, 0) AS n_versions, coalesce(nf.n, 0) AS n_files,
       coalesce(p.status, '') AS preview_status, CASE WHEN p.status = 'ok' THEN '/thumb/' || v.file_hash ELSE '' END AS thumb
FROM assets a JOIN {_LATEST} v ON v.asset_id = a.id LEFT JOIN previews p ON p.file_hash = v.file_hash
LEFT JOIN (SELECT asset_id, count(*) AS n FROM versions GROUP BY 1) nv ON nv.asset_id = a.id
LEFT JOIN (SELECT asset_id, count(*) AS n FROM observed_files GROUP BY 1) nf ON nf.asset_id = a.id""")
def asset_cards(c):
    return cat.asset_cards(c)


_NOTE = """CASE WHEN p.status = 'ok' AND p.alpha_flattened THEN 'Transparansi diratakan ke putih agar gambar kecilnya masuk anggaran ukuran.'
  WHEN p.status = 'ok' THEN '' WHEN p.status = 'unsupported' THEN 'Format ini belum punya gambar kecil. Versinya tetap tersimpan utuh.'
  WHEN p.status = 'failed' AND p.error <> '' THEN 'Gambar kecil gagal dibuat: ' || p.error
  WHEN p.status = 'failed' THEN 'Gambar kecil gagal dibuat. Versinya tetap tersimpan utuh.' ELSE 'Gambar kecil belum dibuat.' END"""


@query(f"""
SELECT v.id, asset_id, v.file_hash, size, observed_at, content_present, pinned, p.status, p.width, p.height, {_NOTE} AS note
FROM versions v LEFT JOIN previews p ON p.file_hash = v.file_hash""")
def timeline(c):
    return cat.timeline(c)


@query(f"SELECT v.id, v.file_hash, v.observed_at, p.status, p.phash, p.bytes FROM versions v JOIN previews p ON p.file_hash = v.file_hash WHERE asset_id = {ASSET}")
def previews_for_asset(c):
    return cat.previews_for(c, ASSET).select("id", "file_hash", "observed_at", "status", "phash", "bytes")


@query("SELECT DISTINCT v.file_hash FROM versions v WHERE NOT EXISTS (SELECT 1 FROM previews p WHERE p.file_hash = v.file_hash)")
def hashes_without_preview(c):
    return cat.hashes_without_preview(c)


@query("""SELECT v.file_hash FROM versions v WHERE NOT EXISTS (SELECT 1 FROM previews p WHERE p.file_hash = v.file_hash)
GROUP BY 1 ORDER BY min((observed_at, id)), file_hash LIMIT 25""")
def hashes_without_preview_topk(c):
    return cat.hashes_without_preview(c, 25)


@query(f"SELECT id, asset_id, observed_at FROM {_LATEST}")
def latest_version(c):
    return cat.latest_version(c.versions).select("id", "asset_id", "observed_at")


@query(f"SELECT * FROM versions WHERE asset_id = {ASSET}")
def versions_of_asset(c):
    return cat.versions_of(c.versions, ASSET)


@query(f"SELECT * FROM assets WHERE id = {ASSET}")
def asset_by_id(c):
    return cat.one(c.assets, "id", ASSET)


@query("SELECT * FROM versions WHERE id = 1")
def version_by_id(c):
    return cat.one(c.versions, "id", 1)


@query("SELECT * FROM previews WHERE file_hash = sha256('4')")
def preview_by_hash(c):
    return cat.one(c.previews, "file_hash", F.sha2(F.lit("4"), 256))


@query("SELECT DISTINCT v.file_hash, coalesce(p.phash, '') AS phash FROM versions v LEFT JOIN previews p ON p.file_hash = v.file_hash")
def preview_phash(c):
    return cat.phash_of(c.previews, c.versions.select("file_hash").distinct())


@query(f"SELECT v.id, CASE WHEN o.last_hash = v.file_hash THEN 'live' WHEN content_present THEN 'copy' ELSE 'gone' END AS opens FROM versions v LEFT JOIN observed_files o ON o.path = v.file_key")
def version_opening(c):
    return vault.opening(c.versions, c.observed_files)


@query("SELECT id, file_hash, file_key, observed_at, content_present AS exportable, regexp_replace(regexp_extract(file_key, '[^/]*$'), '\\.[^.]*$', '') || ' (' || strftime(observed_at, '%Y-%m-%d %H.%M') || ').psd' AS export_name FROM versions")
def export_names(c):
    rows = vault.exportable(c.versions, c.versions.select("id"))
    return rows.withColumn("export_name", text.export_name(F.col("file_key"), F.col("observed_at")))


# --- tracked files -----------------------------------------------------------


@query("SELECT * FROM observed_files")
def tracked_files(c):
    return cat.tracked(c.observed_files)


@query(f"SELECT * FROM observed_files WHERE path LIKE '{PREFIX}%'")
def files_under_prefix(c):
    return cat.files_under(c.observed_files, PREFIX)


@query("SELECT * FROM observed_files WHERE last_hash = sha256('17')")
def files_by_hash(c):
    return cat.files_by_hash(c.observed_files, F.sha2(F.lit("17"), 256))


@query(f"SELECT * FROM observed_files WHERE asset_id = {ASSET}")
def files_of_asset(c):
    return cat.files_of_asset(c.observed_files, ASSET)


@query("SELECT * FROM observed_files WHERE coalesce(last_verified_at, TIMESTAMP '1970-01-01') < TIMESTAMP '1998-08-20' ORDER BY coalesce(last_verified_at, TIMESTAMP '1970-01-01'), path LIMIT 50")
def stale_verified_topk(c):
    return cat.stale_verified(c.observed_files, F.lit("1998-08-20 00:00:00").cast("timestamp_ntz"), 50)


_LISTING = """(SELECT path, CASE WHEN k % 7 = 0 THEN last_size + 1 ELSE last_size END AS size, CASE WHEN k % 11 = 0 THEN last_modified_at + INTERVAL 1 SECOND ELSE last_modified_at END AS mtime
  FROM (SELECT *, CAST(split_part(path, '/', 5) AS BIGINT) AS k FROM observed_files) WHERE k % 6 <> 0)"""


def _listing(c: Catalogue) -> DataFrame:
    k = F.split("path", "/")[4].cast("long")
    rows = c.observed_files.withColumn("k", k).where("k % 6 <> 0")
    return rows.select("path", F.expr("IF(k % 7 = 0, last_size + 1, last_size)").alias("size"), F.expr("IF(k % 11 = 0, last_modified_at + INTERVAL 1 SECOND, last_modified_at)").alias("mtime"))


@query(f"""
SELECT l.path, l.size, l.mtime FROM {_LISTING} l LEFT JOIN observed_files o ON o.path = l.path
WHERE o.path IS NULL OR l.size <> o.last_size OR l.mtime <> o.last_modified_at OR epoch(TIMESTAMP '{td.NOW}') - coalesce(epoch(o.last_verified_at), 0) >= 864000""")
def worth_reading(c):
    from folio.schema import IngestConfig

    return ingest.worth_reading(_listing(c), c.observed_files, now(), IngestConfig(verify_every_s=864000))


@query(f"SELECT o.* FROM observed_files o WHERE NOT EXISTS (SELECT 1 FROM {_LISTING} l WHERE l.path = o.path) AND EXISTS (SELECT 1 FROM watched_folders w WHERE starts_with(o.path, w.path || '/'))")
def vanished(c):
    return ingest.vanished(c.observed_files, _listing(c), c.watched_folders)


@query(f"""
SELECT '/new/' || o.path AS path, min(g.path) AS source
FROM observed_files o JOIN (SELECT * FROM observed_files x WHERE NOT EXISTS (SELECT 1 FROM {_LISTING} l WHERE l.path = x.path)) g ON g.last_hash = o.last_hash
GROUP BY 1""")
def rename_matches(c):
    new = c.observed_files.select(F.concat(F.lit("/new/"), "path").alias("path"), F.col("last_hash").alias("file_hash"))
    return ingest.rename_sources(new, c.observed_files, _listing(c))


_READ = f"""(SELECT path, size, mtime, CASE WHEN size % 3 = 0 THEN sha256(path) ELSE last_hash END AS file_hash, size % 10 <> 7 AS still_same
  FROM (SELECT l.*, o.last_hash FROM {_LISTING} l JOIN observed_files o ON o.path = l.path)
  UNION ALL SELECT '/new/' || path, last_size, last_modified_at, last_hash, true FROM observed_files WHERE last_size % 4 = 0)"""


_OUTCOMES = f"""
, gone AS (SELECT * FROM observed_files x WHERE NOT EXISTS (SELECT 1 FROM {_LISTING} l WHERE l.path = x.path)),
src AS (SELECT path, source FROM (SELECT r.path, (SELECT min(g.path) FROM gone g WHERE g.last_hash = r.file_hash) AS source FROM {_READ} r
        WHERE still_same AND NOT EXISTS (SELECT 1 FROM observed_files o WHERE o.path = r.path)) WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY path) = 1),
outcomes AS (SELECT r.path, CASE WHEN NOT still_same THEN 'moved' WHEN o.last_hash = r.file_hash THEN 'verified' WHEN o.path IS NOT NULL THEN 'new_version' WHEN s.source IS NOT NULL THEN 'renamed' ELSE 'new_asset' END AS outcome,
       coalesce(o.asset_id, so.asset_id) AS asset_id, s.source
FROM {_READ} r LEFT JOIN observed_files o ON o.path = r.path LEFT JOIN src s ON s.path = r.path LEFT JOIN observed_files so ON so.path = s.source)"""


@query(f"{_OUTCOMES} SELECT * FROM outcomes")
def scan_outcomes(c):
    listing = _listing(c)
    own = listing.join(c.observed_files.select("path", "last_hash"), "path")
    read = own.select("path", "size", "mtime", F.when(F.col("size") % 3 == 0, F.sha2("path", 256)).otherwise(F.col("last_hash")).alias("file_hash"), (F.col("size") % 10 != 7).alias("still_same"))
    new = c.observed_files.where("last_size % 4 = 0").select(F.concat(F.lit("/new/"), "path").alias("path"), F.col("last_size").alias("size"), F.col("last_modified_at").alias("mtime"), F.col("last_hash").alias("file_hash"), F.lit(True).alias("still_same"))
    return ingest.classify(read.union(new), c.observed_files, listing).select("path", "outcome", "asset_id", "source")


_COUNTED = ", ".join(f"count(*) FILTER (outcome = '{n}') AS {n}" for n in ("new_version", "new_asset", "renamed", "moved", "verified"))


@query(f"{_OUTCOMES} SELECT {_COUNTED}, count(*) FILTER (outcome IN ('new_version', 'new_asset', 'renamed')) > 0 AS changed FROM outcomes")
def scan_summary(c):
    return ingest.changed_catalogue(ingest.scan_summary(scan_outcomes(c)))


@query("SELECT * FROM watched_folders")
def watched_folders(c):
    return cat.watched(c.watched_folders)


# --- tickets -----------------------------------------------------------------


@query(f"SELECT t.* FROM tickets t JOIN versions v ON v.id = t.version_id WHERE v.asset_id = {ASSET}")
def tickets_for_asset(c):
    return cat.tickets_for(c, ASSET)


@query("SELECT DISTINCT v.file_hash FROM tickets t JOIN versions v ON v.id = t.version_id WHERE t.status <> 'closed'")
def open_ticket_hashes(c):
    return cat.hashes_with_open_ticket(c)


@query("SELECT v.* FROM versions v WHERE EXISTS (SELECT 1 FROM tickets t WHERE t.version_id = v.id AND status <> 'closed')")
def versions_with_open_ticket(c):
    return cat.versions_with_open_ticket(c)


@query("SELECT t.id, v.asset_id FROM tickets t JOIN versions v ON v.id = t.version_id")
def ticket_assets(c):
    return cat.asset_of_ticket(c)


_AGE = f"(epoch(TIMESTAMP '{td.NOW}') - epoch(t.created_at))"


@query(f"""
SELECT t.id, t.version_id, v.asset_id, coalesce(a.name, '') AS asset_name, t.direction, t.status, t.note, t.who, t.created_at, regexp_extract(v.source_path, '[^/]*$') AS file_name,
       CASE WHEN age < 3600 THEN 'baru saja' WHEN age < 86400 THEN CAST(age // 3600 AS BIGINT) || ' jam' WHEN age // 86400 = 1 THEN 'sehari' ELSE CAST(age // 86400 AS BIGINT) || ' hari' END AS age,
       CAST(age // 86400 AS BIGINT) AS age_days, CASE WHEN p.status = 'ok' THEN '/thumb/' || v.file_hash ELSE '' END AS thumb
FROM (SELECT *, CAST(greatest({_AGE}, 0) AS BIGINT) AS age FROM tickets t) t JOIN versions v ON v.id = t.version_id LEFT JOIN assets a ON a.id = v.asset_id LEFT JOIN previews p ON p.file_hash = v.file_hash""")
def ticket_views(c):
    return cat.ticket_views(c, now())


@query("SELECT * FROM tickets WHERE status = 'open' AND direction = 'waiting_on_them'")
def waiting_on_them(c):
    return cat.open_tickets(c.tickets, "waiting_on_them")


@query("SELECT * FROM tickets WHERE status = 'open' AND direction = 'waiting_on_me'")
def waiting_on_me(c):
    return cat.open_tickets(c.tickets, "waiting_on_me")


@query("SELECT * FROM tickets WHERE status = 'maybe_done'")
def review_inbox(c):
    return cat.tickets_by_status(c.tickets, "maybe_done")


@query("SELECT t.id, n.observed_at AS flagged_at FROM tickets t JOIN versions v ON v.id = t.version_id JOIN versions n ON n.asset_id = v.asset_id AND n.id > v.id QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY n.id) = 1")
def ticket_flagging(c):
    return changes.flags_of_history(c.versions, c.tickets)


@query("""
, new AS (SELECT * FROM versions WHERE id % 5 = 0), old AS (SELECT * FROM versions WHERE id % 5 <> 0), t AS (SELECT * FROM tickets WHERE version_id % 5 <> 0)
SELECT t.id, CASE WHEN t.status = 'open' AND n.at IS NOT NULL THEN 'maybe_done' ELSE t.status END AS status, CASE WHEN t.status = 'open' AND n.at IS NOT NULL THEN n.at ELSE t.flagged_at END AS flagged_at
FROM t JOIN old v ON v.id = t.version_id LEFT JOIN (SELECT asset_id, arg_min(observed_at, id) AS at FROM new GROUP BY 1) n ON n.asset_id = v.asset_id""")
def ticket_flagging_on_insert(c):
    new, old = c.versions.where("id % 5 = 0"), c.versions.where("id % 5 <> 0")
    return changes.flag_tickets(c.tickets.where("version_id % 5 <> 0"), old, new).select("id", "status", "flagged_at")


@query(f"SELECT id, CASE WHEN id % 2 = 0 AND id = 6 THEN 'closed' ELSE status END AS status, CASE WHEN id = 6 THEN TIMESTAMP '{td.NOW}' ELSE closed_at END AS closed_at, flagged_at FROM tickets")
def ticket_closed(c):
    return changes.set_ticket_status(c.tickets, 6, "closed", now()).select("id", "status", "closed_at", "flagged_at")


# --- counts ------------------------------------------------------------------


@query("""
SELECT (SELECT count(*) FROM assets) AS assets, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM tickets WHERE status <> 'closed') AS open_tickets,
       (SELECT count(*) FROM tickets WHERE status = 'maybe_done') AS to_review, (SELECT count(*) FROM watched_folders) AS folders, CAST(0 AS BIGINT) AS problems""")
def status_summary(c):
    return cat.status_summary(c)


@query("SELECT (SELECT CAST(sum(size * refcount) AS BIGINT) FROM files) AS logical_bytes, (SELECT CAST(sum(size) AS BIGINT) FROM chunks) AS stored_bytes")
def dedup_savings(c):
    return cat.dedup_savings(c.files, c.chunks)


# --- content store -----------------------------------------------------------


@query("SELECT chunk_hash AS hash, count(*) AS refcount FROM file_chunks GROUP BY 1")
def chunk_refcounts(c):
    return vault.chunk_refcounts(c.file_chunks)


@query("""
, wrong AS (SELECT hash, CASE WHEN CAST(hash AS BIGINT) % 9 = 0 THEN refcount + 1 ELSE refcount END AS recorded FROM chunks WHERE CAST(hash AS BIGINT) % 13 <> 0),
n AS (SELECT chunk_hash AS hash, count(*) AS counted FROM file_chunks GROUP BY 1)
SELECT coalesce(w.hash, n.hash) AS hash, coalesce(recorded, 0) AS recorded, coalesce(counted, 0) AS counted FROM wrong w FULL JOIN n ON n.hash = w.hash WHERE coalesce(recorded, 0) <> coalesce(counted, 0)""")
def wrong_refcounts(c):
    off = c.chunks.where(F.col("hash").cast("long") % 13 != 0).withColumn("refcount", F.col("refcount") + F.when(F.col("hash").cast("long") % 9 == 0, 1).otherwise(0))
    return vault.wrong_refcounts(off, c.file_chunks)


_RELEASED = """, gone AS (SELECT hash FROM files WHERE refcount = 1 AND CAST(hash AS BIGINT) % 2 = 0),
after AS (SELECT c.hash, c.size, c.refcount - coalesce(n, 0) AS refcount FROM chunks c LEFT JOIN
  (SELECT chunk_hash, count(*) AS n FROM file_chunks WHERE file_hash IN (SELECT hash FROM gone) GROUP BY 1) d ON d.chunk_hash = c.hash)"""


def _released(c: Catalogue) -> dict[str, DataFrame]:
    return vault.release(c.files, c.chunks, c.file_chunks, c.files.where(F.col("hash").cast("long") % 2 == 0).select("hash"))


@query(f"{_RELEASED} SELECT * FROM after")
def release_chunks(c):
    return _released(c)["chunks"]


@query("SELECT hash, size, CASE WHEN CAST(hash AS BIGINT) % 2 = 0 THEN refcount - 1 ELSE refcount END AS refcount FROM files WHERE NOT (refcount = 1 AND CAST(hash AS BIGINT) % 2 = 0)")
def release_files(c):
    return _released(c)["files"]


@query(f"{_RELEASED} SELECT count(*) AS chunks, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM after WHERE refcount = 0")
def gc_stats(c):
    return vault.collect_garbage(_released(c)["chunks"])[2]


@on_tables("SELECT CAST(o_orderkey AS VARCHAR) AS hash, o_orderkey AS size FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT hash FROM chunks)")
def orphan_blobs(spark, sf_dir):
    disk = td.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderkey").alias("size"))
    return vault.orphans(disk, td.chunks(spark, sf_dir))


@on_tables("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS hash FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT hash FROM files)")
def stored_hashes(spark, sf_dir):
    asked = td.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("hash")).distinct()
    return vault.exists(td.files(spark, sf_dir), asked.union(asked.select(F.concat("hash", F.lit("x")))))


@on_tables("SELECT CAST(o_custkey AS VARCHAR) AS hash, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS BIGINT) AS refcount FROM orders GROUP BY 1", views=False)
def file_refcounts(spark, sf_dir):
    log = td.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("hash"), F.expr("IF(o_orderstatus = 'F', -1, 1)").alias("delta"))
    return vault.file_refcounts(log)


@on_tables("SELECT sha256(text) AS hash, CAST(any_value(octet_length(encode(text))) AS BIGINT) AS size, count(*) AS refcount FROM documents WHERE text IS NOT NULL GROUP BY 1", views=False)
def stored_contents(spark, sf_dir):
    contents = td.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.encode("text", "UTF-8").alias("content"))
    blank = spark.createDataFrame([], "hash string, size long, refcount long")
    nothing = spark.createDataFrame([], "file_hash string, idx int, chunk_hash string")
    return vault.store(contents, blank, blank, nothing, blank)["files"]


@on_tables("SELECT sha256(text) AS file_hash, CAST(any_value(octet_length(encode(text))) AS BIGINT) AS bytes, true AS whole FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1", views=False)
def chunk_round_trip(spark, sf_dir):
    """Every text cut into small chunks, put together again and hashed."""
    contents = td.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.encode("text", "UTF-8").alias("content")).distinct()
    pieces = vault.chunked(contents, least=256, target=1024, most=4096, strict=12, lax=8)
    whole = vault.put_together(pieces.withColumnRenamed("file_hash", "hash"), F.sum("size").alias("bytes"))
    return whole.select(F.col("hash").alias("file_hash"), "bytes", (F.sha2("content", 256) == F.col("hash")).alias("whole"))


@on_tables("SELECT sha256(text) AS hash, CASE WHEN bool_or(doc_id % 3 = 0) THEN 'ok' ELSE 'missing' END AS state, CAST(CASE WHEN bool_or(doc_id % 3 = 0) THEN any_value(octet_length(encode(text))) END AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1", views=False)
def restore_states(spark, sf_dir):
    docs = td.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    blank = spark.createDataFrame([], "hash string, size long, refcount long")
    nothing = spark.createDataFrame([], "file_hash string, idx int, chunk_hash string")
    made = vault.store(materialize(docs.where("doc_id % 3 = 0"), "contents"), blank, blank, nothing, blank, least=256, target=1024, most=4096, strict=12, lax=8)
    got = vault.restore(made["files"], made["file_chunks"], made["chunk_data"], docs.select(F.sha2("content", 256).alias("hash")).distinct())
    return got.select("hash", "state", F.octet_length("content").cast("long").alias("bytes"))


# --- scalar functions --------------------------------------------------------

_NORMAL = r"""
, stems AS (SELECT DISTINCT path, regexp_replace(regexp_extract(rtrim(path, '/'), '[^/]*$'), '\.[^./]*$', '') AS stem FROM {0}),
n1 AS (SELECT *, regexp_replace(replace(lower(stem), '_', '-'), '\(\s*\d+\s*\)', ' ', 'g') AS n FROM stems),
n2 AS (SELECT path, stem, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n,
   '\b\d{{4}}[-_.]\d{{2}}[-_.]\d{{2}}\b', ' ', 'g'), '\b\d{{2}}[-_.]\d{{2}}[-_.]\d{{4}}\b', ' ', 'g'), '\b\d{{8}}\b', ' ', 'g'), '\b\d{{6}}\b', ' ', 'g'),
   '\b\d{{1,2}}[-_.]\d{{1,2}}[-_.]\d{{2}}\b', ' ', 'g'), '\b\d{{2}}[-_.]\d{{2}}[-_.]\d{{2}}\b', ' ', 'g') AS n FROM n1),
n3 AS (SELECT path, stem, regexp_replace(regexp_replace(n, '[\s_\-.]+', ' ', 'g'), '\b(?:v|ver|versi|rev|revisi|r)\s*[-_.]?\s*\d+\b', ' ', 'g') AS n FROM n2),
normal AS (SELECT path, CASE WHEN len(words) > 0 THEN array_to_string(words, ' ') ELSE lower(trim(regexp_replace(stem, '[\s_\-.]+', ' ', 'g'))) END AS name
  FROM (SELECT path, stem, list_filter(string_split(trim(regexp_replace(n, '\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({1})) AS words FROM n3))
"""
_NOISE = ", ".join(f"'{w}'" for w in text.NOISE_WORDS)
_URLS = "(SELECT url AS path FROM pages)"


@query(f"{_NORMAL.format('observed_files', _NOISE)} SELECT path, name FROM normal")
def normalized_names(c):
    return c.observed_files.select("path", text.normalized_name(F.col("path")).alias("name"))


@on_tables(f"{_NORMAL.format(_URLS, _NOISE)} SELECT path, name FROM normal")
def normalized_urls(spark, sf_dir):
    return td.table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct().withColumn("name", text.normalized_name(F.col("path")))


_SIM = "CASE WHEN {0} = {1} THEN 1.0::DOUBLE WHEN {0} = '' OR {1} = '' THEN 0.0 ELSE greatest(0.0, 1 - CAST(levenshtein({0}, {1}) AS DOUBLE) / greatest(octet_length(encode({0})), octet_length(encode({1})))) END"


@on_tables(f"SELECT a.p_name AS a, b.p_name AS b, {_SIM.format('a.p_name', 'b.p_name')} AS similarity FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name", views=False)
def name_similarity(spark, sf_dir):
    names = td.table(spark, sf_dir, "part").select("p_name").distinct()
    a, b = names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b")
    return a.join(b, F.col("a") < F.col("b")).withColumn("similarity", similarity.name_similarity(F.col("a"), F.col("b")))


@on_tables("SELECT event_id, CASE WHEN gap >= 28800e6 THEN 0.0::DOUBLE ELSE 1 - CAST(gap AS DOUBLE) / 28800e6 END AS closeness FROM (SELECT event_id, abs(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap FROM events) WHERE gap IS NOT NULL", views=False)
def time_closeness(spark, sf_dir):
    from pyspark.sql.window import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = td.table(spark, sf_dir, "events").select("event_id", "ts", before.alias("before")).where("before IS NOT NULL")
    return rows.select("event_id", similarity.time_closeness(F.col("ts"), F.col("before"), 28800).alias("closeness"))


@on_tables("SELECT vec_id, phash FROM hashes")
def phash_bits(spark, sf_dir):
    return td.grids(spark, sf_dir).select("vec_id", similarity.grid_phash(F.col("grid"), F.col("mean")).alias("phash"))


_XOR = "bit_count(xor(a.bits, b.bits))"


@on_tables(f"""
, bits AS (SELECT vec_id, CAST(('0x' || phash) AS UBIGINT) AS bits FROM hashes)
SELECT a.vec_id AS a, b.vec_id AS b, CAST({_XOR} AS INTEGER) AS distance FROM bits a JOIN bits b ON a.vec_id < b.vec_id WHERE {_XOR} <= 20""")
def hamming_pairs(spark, sf_dir):
    hashes = td.grids(spark, sf_dir).select("vec_id", similarity.phash_bits(similarity.grid_phash(F.col("grid"), F.col("mean"))).alias("bits"))
    hashes = materialize(hashes, "bits")
    a, b = hashes.select(F.col("vec_id").alias("a"), F.col("bits").alias("x")), hashes.select(F.col("vec_id").alias("b"), F.col("bits").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", similarity.hamming_bits(F.col("x"), F.col("y")).alias("distance")).where("distance <= 20")


@on_tables("SELECT d AS distance, CASE WHEN d <= 10 THEN 1.0::DOUBLE WHEN d >= 26 THEN 0.0 ELSE 1 - CAST(d - 10 AS DOUBLE) / 16 END AS closeness FROM range(-1, 65) t(d)", views=False)
def image_closeness(spark, sf_dir):
    return spark.range(-1, 65).select(F.col("id").alias("distance"), similarity.image_closeness(F.col("id"), 10, 26).alias("closeness"))


@query("""
, d AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM observed_files)
SELECT a.path AS a, b.path AS b, a.dir = b.dir OR starts_with(a.dir, b.dir || '/') OR starts_with(b.dir, a.dir || '/') AS same
FROM d a JOIN (SELECT path, dir FROM d UNION ALL SELECT dir || '/arsip/x.psd', dir || '/arsip' FROM d) b ON split_part(a.path, '/', 5) = split_part(b.path, '/', 5) OR (split_part(a.path, '/', 3) = '7' AND split_part(b.path, '/', 3) = '7')""")
def folder_tree(c):
    paths = c.observed_files.select("path")
    both = paths.union(paths.select(F.concat(text.dir_name(F.col("path")), F.lit("/arsip/x.psd"))))
    part = lambda n: F.split("path", "/")[n]

    def side(rows: DataFrame, s: str) -> DataFrame:
        rows = rows.select(F.col("path").alias(s), part(2).alias(f"work_{s}"), part(4).alias(f"key_{s}"), text.dir_name(F.col("path")).alias(f"dir_{s}"))
        return rows.withColumn(f"inside_{s}", text.inside_prefix(F.col(f"dir_{s}")))

    a, b = side(paths, "a"), side(both, "b")
    of_work = lambda rows, s: rows.where(F.col(f"work_{s}") == "7").withColumnRenamed(f"work_{s}", "work")
    same = text.related_folders(*(F.col(x) for x in ("dir_a", "dir_b", "inside_a", "inside_b"))).alias("same")
    near = a.join(b, F.col("key_a") == F.col("key_b")).select("a", "b", same)
    return near.union(paired(of_work(a, "a"), of_work(b, "b"), ["work"], 16).where("key_a <> key_b").select("a", "b", same))


@on_tables("SELECT url AS path, regexp_extract(url, '[^/]*$') AS last_part, CASE WHEN regexp_extract(url, '[^/]*$') = '' THEN url ELSE regexp_extract(url, '[^/]*$') END AS ui_name, replace(regexp_replace(url, '/[^/]*$', ''), '/', '\\') AS ui_dir FROM pages", views=False)
def path_parts(spark, sf_dir):
    u = F.col("url")
    return td.table(spark, sf_dir, "pages").select(u.alias("path"), text.last_part(u).alias("last_part"), text.ui_base_name(u).alias("ui_name"), text.ui_dir_name(u).alias("ui_dir"))


@on_tables("SELECT id, CASE WHEN id < 3600 THEN 'baru saja' WHEN id < 86400 THEN (id // 3600) || ' jam' WHEN id // 86400 = 1 THEN 'sehari' ELSE (id // 86400) || ' hari' END AS age, id // 86400 AS days FROM range(0, 4000000, 1777) t(id)", views=False)
def age_text(spark, sf_dir):
    return spark.range(0, 4000000, 1777).select("id", text.age_text(F.col("id")).alias("age"), text.age_days(F.col("id")).alias("days"))


@on_tables("SELECT o_orderkey AS id, CAST(least(greatest(CAST(floor(o_totalprice * 1000) AS BIGINT) // 10485760, 3), 300) AS BIGINT) AS seconds FROM orders", views=False)
def quiet_for(spark, sf_dir):
    return td.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ingest.quiet_for(F.floor(F.col("o_totalprice") * 1000)).alias("seconds"))


@on_tables(r"""
, f AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM (SELECT path || s AS path FROM observed_files, (VALUES (''), ('~'), ('.tmp'), ('.PART'), ('.psd~')) t(s) UNION ALL SELECT regexp_replace(path, '/[^/]*$', p) FROM observed_files, (VALUES ('/~$x.doc'), ('/.~lock.a#'), ('/.#a'), ('/Thumbs.db'), ('/.DS_Store'), ('/desktop.ini')) t(p)))
SELECT path, name ^@ '.~lock.' OR name ^@ '~$' OR name ^@ '.#' OR regexp_matches(lower(name), '\.(tmp|temp|swp|swo|part|partial|crdownload|download)$') OR suffix(name, '~') OR lower(name) IN ('.ds_store', 'thumbs.db', 'desktop.ini') AS noise FROM f""")
def noise_files(spark, sf_dir):
    paths = td.observed_files(spark, sf_dir).select("path")
    ends = paths.withColumn("s", F.explode(F.array(*map(F.lit, ("", "~", ".tmp", ".PART", ".psd~"))))).select(F.concat("path", "s").alias("path"))
    names = paths.withColumn("s", F.explode(F.array(*map(F.lit, ("/~$x.doc", "/.~lock.a#", "/.#a", "/Thumbs.db", "/.DS_Store", "/desktop.ini"))))).select(F.concat(text.dir_name(F.col("path")), "s").alias("path"))
    return ends.union(names).withColumn("noise", text.is_noise_file(F.col("path")))


@on_tables("SELECT o_orderkey AS id, CASE WHEN w <= 0 OR h <= 0 THEN 0 WHEN w <= 512 AND h <= 512 THEN w WHEN w >= h THEN 512 ELSE greatest(1, w * 512 // h) END AS w, CASE WHEN w <= 0 OR h <= 0 THEN 0 WHEN w <= 512 AND h <= 512 THEN h WHEN w >= h THEN greatest(1, h * 512 // w) ELSE 512 END AS h FROM (SELECT o_orderkey, o_custkey AS w, 1 + o_orderkey % 4000 AS h FROM orders)", views=False)
def fit_within(spark, sf_dir):
    w, h = text.fit_within(F.col("o_custkey"), F.col("o_orderkey") % 4000 + 1, 512)
    return td.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), w.alias("w"), h.alias("h"))


@on_tables("""SELECT id, CASE WHEN id < 1024 THEN id || ' B' ELSE replace(regexp_replace(printf('%.1f', round(CASE WHEN id < 1048576 THEN id / 1024 WHEN id < 1073741824 THEN id / 1048576 ELSE id / 1073741824 END, 1)), '\\.0$', ''), '.', ',')
  || CASE WHEN id < 1048576 THEN ' KB' WHEN id < 1073741824 THEN ' MB' ELSE ' GB' END END AS size FROM (SELECT k * k * 64 AS id FROM range(0, 6000, 3) t(k))""", views=False)
def size_text(spark, sf_dir):
    return spark.range(0, 6000, 3).select((F.col("id") * F.col("id") * 64).alias("id")).withColumn("size", text.size_text(F.col("id")))


@on_tables("""SELECT id, CASE WHEN id < 45 THEN 'baru saja' WHEN id < 90 THEN 'semenit lalu' WHEN m < 60 THEN m || ' menit lalu' WHEN h < 24 THEN h || ' jam lalu' WHEN d = 1 THEN 'kemarin' WHEN d < 7 THEN d || ' hari lalu' ELSE '1998-09-01' END AS ago
  FROM (SELECT *, CAST(round(h / 24.0) AS BIGINT) AS d FROM (SELECT *, CAST(round(m / 60.0) AS BIGINT) AS h FROM (SELECT id, CAST(round(id / 60.0) AS BIGINT) AS m FROM range(0, 900000, 13) t(id))))""", views=False)
def relative_text(spark, sf_dir):
    return spark.range(0, 900000, 13).select("id", text.relative_text(F.col("id"), now()).alias("ago"))


@on_tables("SELECT o_orderkey AS id, o_clerk_path AS path, CASE WHEN o_clerk_path LIKE '%.psd' THEN 'psd' WHEN o_clerk_path LIKE '%.PNG' THEN 'image' WHEN o_clerk_path LIKE '%.kra' THEN 'kra' WHEN o_clerk_path LIKE '%.mov' THEN 'video' ELSE '' END AS source FROM (SELECT o_orderkey, '/w/' || o_orderkey || ['.psd', '.PNG', '.kra', '.mov', '.ai', ''][1 + o_orderkey % 6] AS o_clerk_path FROM orders)", views=False)
def preview_sources(spark, sf_dir):
    ends = F.array(*map(F.lit, (".psd", ".PNG", ".kra", ".mov", ".ai", "")))
    path = F.concat(F.lit("/w/"), F.col("o_orderkey").cast("string"), F.element_at(ends, (F.col("o_orderkey") % 6 + 1).cast("int")))
    return td.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), path.alias("path"), text.preview_source(path).alias("source"))


@query("SELECT id, file_hash, substring(file_hash, 1, 12) AS short, regexp_matches(file_hash, '^[0-9a-f]{64}$') AS valid, regexp_matches(substring(file_hash, 1, 60), '^[0-9a-f]{64}$') AS cut_valid FROM versions")
def hash_forms(c):
    h = F.col("file_hash")
    return c.versions.select("id", "file_hash", text.short_hash(h).alias("short"), text.is_content_hash(h).alias("valid"), text.is_content_hash(F.substring(h, 1, 60)).alias("cut_valid"))


# --- resolution of files into works -----------------------------------------

PAIRS = "/*pairs*/"
_CANDS = f"""{_NORMAL.format('observed_files', _NOISE)}
, cands AS (SELECT o.path, o.asset_id, n.name, o.last_modified_at AS at, CASE WHEN regexp_matches(p.phash, '^[0-9a-f]{{16}}$') THEN CAST('0x' || p.phash AS UBIGINT) END AS bits
  FROM observed_files o JOIN normal n ON n.path = o.path LEFT JOIN previews p ON p.file_hash = o.last_hash AND p.status = 'ok')
, base AS (SELECT a.path AS path_a, b.path AS path_b, {_SIM.format('a.name', 'b.name')} AS n, a.name = b.name AS same_name, epoch_us(a.at) AS ta, epoch_us(b.at) AS tb, a.bits AS ba, b.bits AS bb
  FROM cands a JOIN cands b ON a.path < b.path /*pairs*/)
, parts AS (SELECT *, CASE WHEN abs(ta - tb) >= 28800e6 THEN 0.0::DOUBLE ELSE 1 - CAST(abs(ta - tb) AS DOUBLE) / 28800e6 END AS t, CASE WHEN ba IS NULL OR bb IS NULL THEN -1 ELSE CAST(bit_count(xor(ba, bb)) AS INTEGER) END AS d,
    regexp_replace(path_a, '/[^/]*$', '') AS da, regexp_replace(path_b, '/[^/]*$', '') AS db FROM base)
, scored AS (SELECT path_a, path_b, n AS name_score, t AS time_score, CASE WHEN d < 0 OR d >= 26 THEN 0.0::DOUBLE WHEN d <= 10 THEN 1.0 ELSE 1 - CAST(d - 10 AS DOUBLE) / 16 END AS image_score, d AS distance,
    da = db OR starts_with(da, db || '/') OR starts_with(db, da || '/') AS same_tree, same_name FROM parts)
, final AS (SELECT *, distance > 26 AND NOT (same_name AND same_tree) AS vetoed, CASE WHEN distance > 26 AND NOT (same_name AND same_tree) THEN 0.0::DOUBLE WHEN distance >= 0 THEN 0.7::DOUBLE * name_score + 0.1::DOUBLE * time_score + 0.2::DOUBLE * image_score
    ELSE (0.7::DOUBLE * name_score + 0.1::DOUBLE * time_score) / (0.7::DOUBLE + 0.1::DOUBLE) END AS total FROM scored)"""
@query(f"{_CANDS.replace(PAIRS, '')} SELECT path_a, path_b, name_score, time_score, image_score, distance, vetoed, total FROM final WHERE total >= 0.62::DOUBLE")
def score_pairs(c):
    return grouping.scored_pairs(grouping.candidates(c)).select("path_a", "path_b", "name_score", "time_score", "image_score", "distance", "vetoed", "total")


@query(f"""{_CANDS.replace(PAIRS, "AND (CAST(split_part(b.path, '/', 5) AS BIGINT) = CAST(split_part(a.path, '/', 5) AS BIGINT) + 40 OR CAST(split_part(a.path, '/', 5) AS BIGINT) = CAST(split_part(b.path, '/', 5) AS BIGINT) + 40)")}
SELECT f.path_a, f.path_b, name_score, time_score, image_score, distance >= 0 AS has_image, distance, same_tree, vetoed, total, decision,
       CASE WHEN decision = 'together' THEN true WHEN decision = 'apart' THEN false WHEN vetoed THEN false ELSE total >= 0.62::DOUBLE END AS grouped
FROM final f LEFT JOIN decisions d ON d.path_a = f.path_a AND d.path_b = f.path_b""")
def explain_pairs(c):
    keyed = c.observed_files.select("path", F.split("path", "/")[4].cast("long").alias("k"))
    pairs = keyed.join(keyed.select(F.col("path").alias("other"), (F.col("k") - 40).alias("k")), "k").select(F.least("path", "other").alias("path_a"), F.greatest("path", "other").alias("path_b"))
    return grouping.explain(c, pairs).select("path_a", "path_b", "name_score", "time_score", "image_score", "has_image", "distance", "same_tree", "vetoed", "total", "decision", "grouped")


@query(f"SELECT path_a AS a, path_b AS b, decision FROM decisions")
def decisions_for_pairs(c):
    return cat.decision_for(c.grouping_decisions, c.grouping_decisions.select(F.col("path_b").alias("b"), F.col("path_a").alias("a"))).select("a", "b", "decision")


@query("SELECT DISTINCT o.last_hash AS file_hash FROM observed_files o JOIN previews p ON p.file_hash = o.last_hash WHERE p.status = 'ok' AND p.phash = ''")
def hashes_to_make(c):
    return grouping.hashes_to_make(c)


@query()
def clusters(c):
    return grouping.clusters(grouping.candidates(c), c.grouping_decisions).select("path", "cluster")


@query(f"""{_CANDS.replace(PAIRS, '')}
, links AS (SELECT path_a AS a, path_b AS b FROM final WHERE total >= 0.62::DOUBLE UNION SELECT path_b, path_a FROM final WHERE total >= 0.62::DOUBLE)
SELECT a AS path, count(*) AS n_links FROM links GROUP BY 1""")
def link_counts(c):
    return grouping.link_counts(grouping.candidates(c))


@query("SELECT o.path, o.asset_id, m.target FROM observed_files o JOIN (SELECT last_hash, min(asset_id) AS target FROM observed_files GROUP BY 1) m ON m.last_hash = o.last_hash")
def canonical_assets(c):
    of = c.observed_files.select("path", F.col("last_hash").alias("cluster"))
    return grouping.canonical_assets(c.observed_files, of)


# --- changes -----------------------------------------------------------------


@query("SELECT id FROM assets WHERE id NOT IN (SELECT asset_id FROM versions) AND id NOT IN (SELECT asset_id FROM observed_files)")
def empty_assets(c):
    return c.assets.select("id").join(changes.delete_empty_assets(c).select("id"), "id", "left_anti")


@query(f"""SELECT id, CASE WHEN content_present AND file_hash IN (SELECT file_hash FROM versions WHERE asset_id = {ASSET}) THEN TIMESTAMP '{td.NOW}' ELSE content_released_at END AS content_released_at,
content_present AND file_hash NOT IN (SELECT file_hash FROM versions WHERE asset_id = {ASSET}) AS content_present FROM versions""")
def content_released(c):
    hashes = c.versions.where(F.col("asset_id") == ASSET).select("file_hash")
    return changes.release_content(c.versions, hashes, now()).select("id", "content_released_at", "content_present")


@query("SELECT path, CASE WHEN k % 3 = 0 THEN 1 ELSE k % 150 + 1 END AS asset_id FROM paths")
def files_moved(c):
    moves = c.observed_files.where(F.split("path", "/")[4].cast("long") % 3 == 0).select("path", F.lit(1).cast("long").alias("asset_id"))
    return changes.move_files(c, moves, now())[2].select("path", "asset_id")


@query("SELECT path, CASE WHEN k % 4 = 0 THEN -1 ELSE k % 150 + 1 END AS asset_id FROM paths WHERE k % 9 <> 0")
def observed_upserted(c):
    k = F.split("path", "/")[4].cast("long")
    rows = c.observed_files.where(k % 4 == 0).withColumn("asset_id", F.lit(-1).cast("long"))
    return changes.delete_observed(changes.put_observed(c.observed_files, rows), c.observed_files.where(k % 9 == 0)).select("path", "asset_id")


@query(f"SELECT path_a, path_b, 'apart' AS decision, TIMESTAMP '{td.NOW}' AS decided_at FROM decisions WHERE decision = 'together' UNION ALL SELECT * FROM decisions WHERE decision <> 'together'")
def decisions_changed(c):
    flipped = c.grouping_decisions.where("decision = 'together'").select(F.col("path_b").alias("a"), F.col("path_a").alias("b"), F.lit("apart").alias("decision"), now().alias("decided_at"))
    return changes.put_decisions(c.grouping_decisions, flipped)


@query("SELECT least('/new' || path_a, path_b) AS path_a, greatest('/new' || path_a, path_b) AS path_b, decision, decided_at FROM decisions WHERE path_a NOT IN (SELECT path_b FROM decisions) UNION ALL SELECT least('/new' || path_a, CASE WHEN path_b IN (SELECT path_a FROM decisions) THEN '/new' || path_b ELSE path_b END), 'x', decision, decided_at FROM decisions WHERE false")
def decisions_renamed(c):
    inner = c.grouping_decisions.join(c.grouping_decisions.select(F.col("path_b").alias("path_a")), "path_a", "left_anti")
    renames = inner.select(F.col("path_a").alias("old"), F.concat(F.lit("/new"), "path_a").alias("new")).distinct()
    return changes.rename_in_decisions(inner, renames)


@query("SELECT DISTINCT version_id FROM tickets WHERE version_id NOT IN (SELECT id FROM versions WHERE id % 4 <> 0)")
def broken_tickets(c):
    kept = Catalogue(**{**c.__dict__, "versions": c.versions.where("id % 4 <> 0")})
    return changes.tickets_without_version(kept).select("version_id").distinct()


@query("SELECT id FROM versions WHERE id % 4 = 0")
def lost_versions(c):
    return changes.lost_versions(c.versions, c.versions.where("id % 4 <> 0")).select("id")


@query("SELECT id, CASE WHEN id = 1 THEN NOT pinned ELSE pinned END AS pinned FROM versions")
def version_pinned(c):
    row = c.versions.where("id = 1").first()
    return (changes.set_pinned(c.versions, 1, not row["pinned"]) if row else c.versions).select("id", "pinned")


@query(f"SELECT path FROM watched_folders UNION SELECT '/new/' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def folders_added(c):
    more = c.watched_folders.where(F.split("path", "/")[2].cast("int") % 2 == 0)
    new = more.select(F.regexp_replace("path", "^/work", "/new/.").alias("path"), "added_at").union(more.select(F.concat("path", F.lit("/")), "added_at"))
    return changes.add_folders(c.watched_folders, new).select("path")


@query("SELECT id, CASE WHEN id % 100 = 0 THEN TIMESTAMP '1998-09-01' ELSE updated_at END AS updated_at FROM assets")
def assets_touched(c):
    return changes.touch_assets(c.assets, c.assets.where("id % 100 = 0").select("id"), now()).select("id", "updated_at")


@query("SELECT id, CASE WHEN file_key LIKE '%/file_1.psd' THEN '/moved' || file_key ELSE file_key END AS file_key FROM versions")
def file_keys_renamed(c):
    old = c.versions.where(F.col("file_key").endswith("/file_1.psd")).select(F.col("file_key").alias("old")).distinct()
    return changes.rename_file_key(c.versions, old.withColumn("new", F.concat(F.lit("/moved"), "old"))).select("id", "file_key")


@query("SELECT p.file_hash, CASE WHEN status = 'failed' THEN 'ok' ELSE status END AS status, phash FROM previews p")
def previews_replaced(c):
    retried = c.previews.where("status = 'failed'").withColumns({"status": F.lit("ok"), "phash": F.lit("f" * 16)})
    return changes.put_previews(c.previews, retried).select("file_hash", "status", "phash")


@query("SELECT file_hash, CASE WHEN status = 'ok' AND phash = '' THEN 'ffffffffffffffff' ELSE phash END AS phash FROM previews")
def phashes_set(c):
    return changes.set_phash(c.previews, c.previews.where("status = 'ok' AND phash = ''").select("file_hash", F.lit("f" * 16).alias("phash"))).select("file_hash", "phash")


@on_tables("SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY n_name) AS id, n_name AS name FROM nation", views=False)
def assets_created(spark, sf_dir):
    names = td.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    assets = td.assets(spark, sf_dir)
    return changes.create_assets(assets, names, now()).select("id", "name").join(assets.select("id"), "id", "left_anti")


@query(f"SELECT f.hash, f.size FROM (SELECT DISTINCT chunk_hash FROM file_chunks WHERE file_hash IN (SELECT CAST(id AS VARCHAR) FROM versions WHERE asset_id = {ASSET} AND content_present)) d JOIN chunks f ON f.hash = d.chunk_hash")
def bundle_chunks(c):
    by_id = c.versions.withColumn("file_hash", F.col("id").cast("string"))
    return retention.bundle(Catalogue(**{**c.__dict__, "versions": by_id}), ASSET)


# --- saves, retention, sync --------------------------------------------------


@on_tables("""
SELECT path, min(seen_at) AS start, max(seen_at) AS last, count(*) AS n FROM (
  SELECT *, sum(b) OVER (PARTITION BY path ORDER BY seen_at, size ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN epoch_us(seen_at) - epoch_us(lag(seen_at) OVER (PARTITION BY path ORDER BY seen_at, size)) < 7200e6 THEN 0 ELSE 1 END AS b FROM sightings))
GROUP BY path, run""")
def debounce_sessions(spark, sf_dir):
    return ingest.settled_saves(td.sightings(spark, sf_dir), 7200).select("path", "start", "last", "n")


_WAITING = "(SELECT DISTINCT version_id FROM tickets WHERE status <> 'closed')"


@query(f"""
SELECT v.id, l.id IS NOT NULL AS newest, v.pinned, w.version_id IS NOT NULL AS ticket FROM versions v LEFT JOIN {_LATEST} l ON l.id = v.id LEFT JOIN {_WAITING} w ON w.version_id = v.id
WHERE l.id IS NOT NULL OR v.pinned OR w.version_id IS NOT NULL""")
def retention_immune(c):
    return retention.immune(c)


@query(f"""
, aged AS (SELECT id, asset_id, observed_at, date_diff('day', observed_at, TIMESTAMP '{td.NOW}') AS age FROM versions WHERE content_present),
b AS (SELECT *, CASE WHEN age <= 7 THEN 'all' WHEN age <= 30 THEN 'day:' || strftime(observed_at, '%Y-%m-%d') WHEN age <= 365 THEN 'week:' || strftime(date_trunc('week', observed_at), '%Y-%m-%d') ELSE 'month:' || strftime(date_trunc('month', observed_at), '%Y-%m-%d') END AS bucket FROM aged)
SELECT b.id, b.asset_id, b.bucket, b.bucket = 'all' OR row_number() OVER (PARTITION BY b.asset_id, b.bucket ORDER BY b.observed_at DESC, b.id DESC) = 1
       OR b.id IN (SELECT id FROM {_LATEST}) OR b.id IN (SELECT id FROM versions WHERE pinned) OR b.id IN (SELECT version_id FROM {_WAITING}) AS keep FROM b""")
def retention_buckets(c):
    return retention.thinned(c, now())


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS hash FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def sync_missing(c):
    return retention.missing(c.file_chunks.select(F.col("chunk_hash").alias("hash")), c.chunks.where(F.col("hash").cast("long") % 3 == 0))


# --- single rows, tickets of a version, rules ----------------------------------

_KEY = "CAST(split_part(path, '/', 5) AS BIGINT)"


def _path(c: Catalogue, k: int) -> str:
    return c.observed_files.where(F.split("path", "/")[4] == str(k)).first()["path"]


@query("SELECT * FROM observed_files WHERE split_part(path, '/', 5) = '7'")
def tracked_file_by_path(c):
    return cat.one(c.observed_files, "path", _path(c, 7))


@query("SELECT * FROM tickets WHERE id = 3")
def ticket_by_id(c):
    return cat.one(c.tickets, "id", 3)


@query("SELECT * FROM decisions")
def all_decisions(c):
    return cat.all_decisions(c.grouping_decisions)


@query("SELECT id, version_id, status <> 'closed' AS live FROM tickets WHERE version_id = 3")
def tickets_of_version(c):
    return cat.tickets_on(c.tickets, 3).select("id", "version_id", "live")


@query("SELECT version_id, count(*) FILTER (status <> 'closed') AS live, count(*) FILTER (status = 'closed') AS closed FROM tickets GROUP BY 1")
def ticket_split(c):
    return cat.ticket_split(c.tickets)


@query("SELECT 'versions' AS \"table\", asset_id FROM versions WHERE asset_id % 7 = 0 UNION ALL SELECT 'observed_files', asset_id FROM observed_files WHERE asset_id % 7 = 0")
def rows_without_asset(c):
    return changes.rows_without_asset(Catalogue(**{**c.__dict__, "assets": c.assets.where("id % 7 <> 0")}))


@query("SELECT id FROM versions WHERE pinned")
def versions_without_key(c):
    return changes.versions_without_key(c.versions.withColumn("file_key", F.when(F.col("pinned"), "").otherwise(F.col("file_key")))).select("id")


@query("""SELECT 'previews' AS "table", file_hash AS key FROM previews WHERE status = 'failed' UNION ALL SELECT 'tickets', CAST(id AS VARCHAR) FROM tickets WHERE direction = 'waiting_on_me'
UNION ALL SELECT 'grouping_decisions', path_b FROM decisions WHERE decision = 'apart' UNION ALL SELECT 'chunks', hash FROM chunks WHERE refcount > 30""")
def bad_values(c):
    spoilt = Catalogue(**{
        **c.__dict__, "previews": c.previews.withColumn("status", F.expr("IF(status = 'failed', 'odd', status)")), "tickets": c.tickets.withColumn("direction", F.expr("IF(direction = 'waiting_on_me', NULL, direction)")),
        "grouping_decisions": c.grouping_decisions.selectExpr("IF(decision = 'apart', path_b, path_a) AS path_a", "IF(decision = 'apart', path_a, path_b) AS path_b", "decision", "decided_at"),
        "chunks": c.chunks.withColumn("refcount", F.expr("IF(refcount > 30, -1, refcount)")),
    })
    return changes.bad_values(spoilt)


@query(f"""SELECT (SELECT max(id) FROM versions) + row_number() OVER (ORDER BY last_modified_at, path) AS id, asset_id, last_hash AS file_hash, CASE WHEN {_KEY} % 2 = 0 THEN path ELSE path || '.key' END AS file_key, true AS content_present, observed_files.path AS source_path
FROM observed_files""")
def versions_added(c):
    key = F.when(F.split("path", "/")[4].cast("long") % 2 == 0, "").otherwise(F.concat("path", F.lit(".key")))
    rows = c.observed_files.select("asset_id", F.col("last_hash").alias("file_hash"), F.col("last_size").alias("size"), F.col("last_modified_at").alias("observed_at"), F.col("last_modified_at").alias("modified_at"), F.col("path").alias("source_path"), key.alias("file_key"), F.lit(False).alias("pinned"))
    return changes.add_versions(c.versions, rows).join(c.versions.select("id"), "id", "left_anti").select("id", "asset_id", "file_hash", "file_key", "content_present", "source_path")


@query("SELECT (SELECT max(id) FROM tickets) + row_number() OVER (ORDER BY observed_at, id) AS id, id AS version_id, 'open' AS status, 'waiting_on_me' AS direction FROM versions WHERE pinned")
def tickets_added(c):
    rows = c.versions.where("pinned").select(F.col("id").alias("version_id"), F.lit("waiting_on_me").alias("direction"), F.lit("look").alias("note"), F.lit("me").alias("who"), F.col("observed_at").alias("created_at"))
    return changes.add_tickets(c.tickets, rows).join(c.tickets.select("id"), "id", "left_anti").select("id", "version_id", "status", "direction")


@query("SELECT path FROM watched_folders WHERE path <> '/work/3'")
def folder_removed(c):
    return changes.remove_folder(c.watched_folders, "/work/3").select("path")


@query("SELECT path, CASE WHEN k = 151 THEN (SELECT max(id) + 1 FROM assets) ELSE k % 150 + 1 END AS asset_id FROM paths")
def split_files(c):
    return grouping.split(c, _path(c, 1), _path(c, 151), now()).observed_files.select("path", "asset_id")


@query("SELECT path, CASE WHEN k = 2 THEN 2 ELSE k % 150 + 1 END AS asset_id FROM paths")
def merged_files(c):
    return grouping.merge(c, _path(c, 1), _path(c, 2), now()).observed_files.select("path", "asset_id")


@query("SELECT least(a.path, b.path) AS path_a, greatest(a.path, b.path) AS path_b FROM paths a JOIN paths b ON a.k = 151 AND b.k <> 151 AND b.k % 150 = 1")
def detached_decisions(c):
    after = grouping.detach(c, _path(c, 151), now()).grouping_decisions
    return after.where(F.col("decided_at") == now()).select("path_a", "path_b")


@query("SELECT path, CASE WHEN k = 151 THEN (SELECT max(id) + 1 FROM assets) ELSE k % 150 + 1 END AS asset_id FROM paths")
def detached_files(c):
    return grouping.detach(c, _path(c, 151), now()).observed_files.select("path", "asset_id")


@on_tables(r"SELECT page_id, regexp_replace(url, '([\\%_])', '\\\1', 'g') AS escaped FROM pages", views=False)
def like_escaped(spark, sf_dir):
    return td.table(spark, sf_dir, "pages").select("page_id", text.like_escaped(F.col("url")).alias("escaped"))


@on_tables("SELECT event_id, CASE WHEN value - 20 > 0 THEN (value - 20) / 10 ELSE 2.0 END AS seek FROM events", views=False)
def seek_seconds(spark, sf_dir):
    return td.table(spark, sf_dir, "events").select("event_id", text.seek_seconds(F.col("value") - 20).alias("seek"))


@on_tables("""WITH tries AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, CASE WHEN event_id % 40 = 0 THEN 'free' WHEN event_id % 5 = 0 THEN 'locked' ELSE 'unknown' END AS state FROM events)
SELECT path, count(*) AS attempts FROM tries t WHERE state = 'unknown' AND NOT EXISTS (SELECT 1 FROM tries o WHERE o.path = t.path AND o.state = 'free' AND o.ts >= t.ts) GROUP BY path HAVING count(*) >= 5""", views=False)
def open_problems(spark, sf_dir):
    state = F.expr("CASE WHEN event_id % 40 = 0 THEN 'free' WHEN event_id % 5 = 0 THEN 'locked' ELSE 'unknown' END")
    return ingest.problems(td.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), state.alias("state"), F.col("ts").alias("at")))
