"""Names, paths, wording and signals against fixed cases."""

import pytest
from pyspark.sql import functions as F

from folio.functions import similarity, text
from folio.operators import ingest

NAMES = [
    ("poster-kampus.psd", "poster kampus"), ("poster kampus final.psd", "poster kampus"), ("poster_kampus_fix.psd", "poster kampus"), ("poster kampus revisi 3.psd", "poster kampus"),
    ("Poster Kampus FINAL ASLI.psd", "poster kampus"), ("poster_kampus_v2 (1).psd", "poster kampus"), ("poster-kampus-20260909.psd", "poster kampus"), ("logo v2.png", "logo"), ("logo_v10.png", "logo"),
    ("logo-ver3.png", "logo"), ("logo versi 4.png", "logo"), ("logo rev2.png", "logo"), ("logo_revisi_7.png", "logo"), ("brosur fix final banget.psd", "brosur"), ("brosur_final_fix_ok.psd", "brosur"),
    ("undangan revisi 2 FIX ASLI.psd", "undangan"), ("kartu nama new terbaru.ai", "kartu nama"), ("spanduk done selesai.psd", "spanduk"), ("feed 2026-09-09.png", "feed"), ("feed_09-09-2026.png", "feed"),
    ("feed 20260909.png", "feed"), ("feed-260909.png", "feed"), ("katalog (1).psd", "katalog"), ("katalog (12).psd", "katalog"), ("katalog - Copy.psd", "katalog"), ("salinan katalog.psd", "katalog"),
    ("MENU___MAKANAN.psd", "menu makanan"), ("menu---makanan.psd", "menu makanan"), ("Menu.Makanan.psd", "menu makanan"), ("  menu  makanan  .psd", "menu makanan"), ("logo 2.png", "logo 2"), ("logo-3.png", "logo 3"),
    ("final fix ok.psd", "final fix ok"), (".psd", ""), ("kopié2026-09-09.psd", "kopié"),
]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)])
    return [r[0] for r in rows.select(expr(*(F.col(f"_{k + 2}") for k in range(len(rows.columns) - 1))), "_1").orderBy("_1").collect()]


def test_normalized_names(spark):
    assert column(spark, [f"/kerja/{n}" for n, _ in NAMES], text.normalized_name) == [w for _, w in NAMES]


def test_edit_distance_counts_bytes(spark):
    cases = [("", "", 0), ("abc", "abc", 0), ("abc", "", 3), ("kitten", "sitting", 3), ("poster", "poster2", 1), ("a", "é", 2)]
    assert column(spark, [(a, b) for a, b, _ in cases], similarity.byte_levenshtein) == [d for *_, d in cases]


@pytest.mark.parametrize("a,b,low,high", [("poster kampus", "poster kampus", 1, 1), ("poster kampus", "poster kampuss", 0.85, 0.99), ("logo warung", "logo warung 2", 0.80, 0.95), ("poster kampus", "logo kopi", 0, 0.45), ("", "apa saja", 0, 0), ("", "", 1, 1)])
def test_name_similarity(spark, a, b, low, high):
    assert low <= column(spark, [(a, b)], similarity.name_similarity)[0] <= high


def test_folder_tree(spark):
    cases = [
        ("k/logo.png", "k/logo2.png", True), ("k/a/logo.png", "k/a/arsip/logo.png", True), ("k/a/arsip/logo.png", "k/a/logo.png", True), ("k/a/x/y/logo.png", "k/a/logo.png", True),
        ("k/a/logo.png", "k/b/logo.png", False), ("k/proyek/logo.png", "k/proyek-lain/logo.png", False), ("k/klien-a/logo.png", "k/klien-b/logo.png", False), ("/x.png", "/a/b/y.png", True),
    ]
    assert column(spark, [(a, b) for a, b, _ in cases], text.same_folder_tree) == [w for *_, w in cases]


def test_hamming(spark):
    a, b = "00" * 8, "ff" + "00" * 7
    cases = [(a, a, 0), (a, b, 8), ("", a, -1), (a, "zz" * 8, -1), (a, "FF" * 8, 64), (a, "0", -1)]
    assert column(spark, [(x, y) for x, y, _ in cases], similarity.hamming) == [w for *_, w in cases]


def test_age_and_size_texts(spark):
    h, d = 3600, 86400
    assert column(spark, [0, 40 * 60, 5 * h, 23 * h, 25 * h, 6 * d, 40 * d], text.age_text) == ["baru saja", "baru saja", "5 jam", "23 jam", "sehari", "6 hari", "40 hari"]
    assert column(spark, [0, 1023, 1024, 1536, 5 << 20, 3 << 30, 2 << 40, 2000 << 40], text.size_text) == ["0 B", "1023 B", "1 KB", "1,5 KB", "5 MB", "3 GB", "2 TB", "2000 TB"]


def test_relative_texts(spark):
    ages = [10, 60, 300, 7200, 86400, 3 * 86400, 30 * 86400]
    at = F.lit("2026-09-09 12:30:00").cast("timestamp")
    assert column(spark, ages, lambda s: text.relative_text(s, at)) == ["baru saja", "semenit lalu", "5 menit lalu", "2 jam lalu", "kemarin", "3 hari lalu", "2026-09-09"]


def test_quiet_times(spark):
    assert column(spark, [0, 10 << 20, 40 << 20, 10 << 30, 1 << 50], ingest.quiet_for) == [3, 3, 4, 300, 300]


def test_paths(spark):
    paths = ["/a/b.psd", "b.psd", "/", "", "/a/", "a//b/c.x.y"]
    assert column(spark, paths, text.base_name) == ["b.psd", "b.psd", "/", ".", "a", "c.x.y"]
    assert column(spark, paths, text.stem) == ["b", "b", "/", "", "a", "c.x"]
    folders = ["/a/b/", "/a//b/./c", "", ".", "/", "a/../b", "/..", "../a", "a/.."]
    assert column(spark, folders, text.clean_folder) == ["/a/b", "/a/b/c", None, None, "/", "b", "/", "../a", None]
    assert column(spark, ["/x/y.png", "/", ""], lambda p: text.export_name(p, F.lit("2026-09-09 10:05:00").cast("timestamp"))) == ["y (2026-09-09 10.05).png", "versi (2026-09-09 10.05)", "versi (2026-09-09 10.05)"]


def test_noise(spark):
    noisy = ["/a/.~lock.x#", "/a/~$x.docx", "/a/.#x", "/a/x.TMP", "/a/x.psd~", "/a/x~", "/a/.x.kra~", "/a/Thumbs.db", "/a/.DS_Store", "/a/x.crdownload"]
    assert all(column(spark, noisy, text.is_noise_file))
    assert not any(column(spark, ["/a/x.psd", "/a/lock.psd", "/a/tmp", "/a.tmp/x.png", "/a/$x"], text.is_noise_file))
    dirs = [("/w/.git/x", "/w", True), ("/w/Node_Modules/a/x", "/w", True), ("/w/.git/x", "/w/.git", False), ("/w/git/x", "/w", False), ("/w/x", "/w", False)]
    assert column(spark, [(a, b) for a, b, _ in dirs], text.in_noise_dir) == [w for *_, w in dirs]
