"""Names, paths and wording as column expressions; no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these words and patterns.
NOISE_WORDS = (
    "final", "finals", "fix", "fixed", "fixes", "ok", "okay", "done", "new", "latest", "last", "draft", "sketch", "copy", "edit", "edited",
    "revised", "revision", "clean", "use", "used", "real", "print", "web",
    "oke", "sip", "selesai", "jadi", "asli", "baru", "terbaru", "akhir", "banget", "bgt", "beneran", "sketsa", "salinan", "coba", "percobaan",
    "revisi", "perbaikan", "benerin", "pakai", "dipakai", "cetak", "kirim", "bener", "fixx", "fiks",
)
COPY_COUNTER = r"\(\s*\d+\s*\)"
DATES = (r"\d{4}[-_.]\d{2}[-_.]\d{2}", r"\d{2}[-_.]\d{2}[-_.]\d{4}", r"\d{8}", r"\d{6}", r"\d{1,2}[-_.]\d{1,2}[-_.]\d{2}")
TIME_STAMP = r"\d{2}[-_.]\d{2}[-_.]\d{2}"
SEPARATORS = r"[\s_\-.]+"
VERSION_MARKER = r"(?:v|ver|versi|rev|revisi|r)\s*[-_.]?\s*\d+"
SKIPPED_DIRS = (".git", ".svn", ".hg", "node_modules", "$recycle.bin", "system volume information", ".cit")
SKIPPED_PREFIXES = (".~lock.", "~$", ".#")
SKIPPED_SUFFIXES = (".tmp", ".temp", ".swp", ".swo", ".part", ".partial", ".crdownload", ".download", ".psd~")
SKIPPED_NAMES = (".ds_store", "thumbs.db", "desktop.ini")

# ASCII word boundaries, which Java's \b beside other letters is not
_BEGIN, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def base_name(path: Column) -> Column:
    """The last part of a slash-separated path; "." for the empty one, "/" for the root."""
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", ".").when(trimmed == "", "/").otherwise(F.regexp_extract(trimmed, "[^/]*$", 0))


def dir_name(path: Column) -> Column:
    """What lies before the last part; "." without a slash, "/" for the root."""
    head = F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/+$", "")
    return F.when(~path.contains("/"), ".").when(head == "", "/").otherwise(head)


def dir_length(path: Column) -> Column:
    """How much of the path dir_name() is; 0 for "." and -1 for "/"."""
    folder = dir_name(path)
    return F.when(folder == ".", 0).when(folder == "/", -1).otherwise(F.length(folder))


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"\.[^./]*$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^./]*$", "")


def last_part(path: Column) -> Column:
    """The name behind the last slash of either kind."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def ui_base_name(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", "").when(last_part(path) == "", path).otherwise(last_part(path))


def ui_dir_name(path: Column) -> Column:
    parts = F.split(path, r"[\\/]")
    head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "\\")
    return F.when(F.coalesce(path, F.lit("")) == "", "").when(head == "", path).otherwise(head)


def normalized_name(path: Column) -> Column:
    """The part of a file name that tells which work it is."""
    name = F.translate(F.lower(stem(path)), "_", "-")
    name = F.regexp_replace(name, COPY_COUNTER, " ")
    for p in (*DATES, TIME_STAMP):
        name = F.regexp_replace(name, f"{_BEGIN}{p}{_END}", " ")
    name = F.regexp_replace(name, SEPARATORS, " ")
    name = F.regexp_replace(name, f"{_BEGIN}{VERSION_MARKER}{_END}", " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " "), lambda w: (w != "") & ~w.isin(*NOISE_WORDS))
    plain = F.lower(F.trim(F.regexp_replace(stem(path), SEPARATORS, " ")))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(plain)


def is_noise_file(path: Column) -> Column:
    """Lock, swap, download and system files, which are nobody's work."""
    name = base_name(path)
    low = F.lower(name)
    found = low.isin(*SKIPPED_NAMES) | name.endswith("~")
    for p in SKIPPED_PREFIXES:
        found |= name.startswith(p)
    for s in SKIPPED_SUFFIXES:
        found |= low.endswith(s)
    return found


def in_noise_dir(path: Column, root: Column) -> Column:
    """Whether a folder below root, root itself excepted, is one that nobody descends into."""
    inside = F.split(dir_name(F.substr(path, F.length(root) + 1)), "/")
    return F.exists(inside, lambda d: F.lower(d).isin(*SKIPPED_DIRS))


def same_folder_tree(a: Column, b: Column) -> Column:
    """Whether two files lie in one folder, or one's folder lies inside the other's."""
    x, y = dir_name(a), dir_name(b)
    return related_folders(x, y, inside_prefix(x), inside_prefix(y))


def inside_prefix(folder: Column) -> Column:
    """What the folders inside a folder begin with."""
    return F.when(folder == "/", "/").otherwise(F.concat(folder, F.lit("/")))


def related_folders(x: Column, y: Column, inside_x: Column, inside_y: Column) -> Column:
    """Whether two folders (of dir_name(), with their inside_prefix()) are one or one lies inside the other: for pairs, whose sides have these as columns made before."""
    inside = lambda inner, outer, prefix: inner.startswith(prefix) | (outer == ".") & ~inner.startswith("/")
    return (x == y) | inside(x, y, inside_y) | inside(y, x, inside_x)


def related_by_length(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """same_folder_tree() of two paths from their dir_length(): short, for pairs. A slash follows a folder of some length."""
    n = F.least(n_a, n_b)
    longer = F.when(n_a > n_b, a).otherwise(b)
    return F.when(n > 0, a.substr(F.lit(1), n + 1) == b.substr(F.lit(1), n + 1)).when(n_a == n_b, True).otherwise((F.greatest(n_a, n_b) > 0) & (longer.startswith("/") == (n < 0)))


def clean_folder(path: Column) -> Column:
    """The shortest equal path: no doubled or trailing slashes, no "." or inner ".." parts; null for "" and "."."""
    rooted = path.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        back = (part == "..") & last.isNotNull() & (last != "..")
        return F.when(back, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when((part == "..") & rooted, kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    joined = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")
    whole = F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(whole != "", whole)


def short_hash(h: Column) -> Column:
    return F.substring(h, 1, 12)


def is_content_hash(h: Column) -> Column:
    return F.coalesce(h.rlike("^[0-9a-f]{64}$"), F.lit(False))


def thumb_url(status: Column, file_hash: Column) -> Column:
    return F.when((status == "ok") & (file_hash != ""), F.concat(F.lit("/thumb/"), file_hash)).otherwise("")


def preview_note(status: Column, alpha_flattened: Column, error: Column) -> Column:
    return (
        F.when((status == "ok") & alpha_flattened, "Transparansi diratakan ke putih agar gambar kecilnya masuk anggaran ukuran.")
        .when(status == "ok", "")
        .when(status == "unsupported", "Format ini belum punya gambar kecil. Versinya tetap tersimpan utuh.")
        .when((status == "failed") & (error != ""), F.concat(F.lit("Gambar kecil gagal dibuat: "), error))
        .when(status == "failed", "Gambar kecil gagal dibuat. Versinya tetap tersimpan utuh.")
        .otherwise("Gambar kecil belum dibuat.")
    )


def age_text(seconds: Column) -> Column:
    hours, days = F.floor(seconds / 3600), F.floor(seconds / 86400)
    return F.when(seconds < 3600, "baru saja").when(seconds < 86400, F.concat(hours.cast("string"), F.lit(" jam"))).when(days == 1, "sehari").otherwise(F.concat(days.cast("string"), F.lit(" hari")))


def age_days(seconds: Column) -> Column:
    return F.floor(seconds / 86400)


def relative_text(seconds: Column, at: Column) -> Column:
    """How long ago `at` was, for an age in seconds; a date from a week on."""
    minutes = F.round(seconds / 60)
    hours = F.round(minutes / 60)
    days = F.round(hours / 24)
    said = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f" {unit} lalu"))
    return (
        F.when(at.isNull(), "").when(seconds < 0, F.date_format(at, "yyyy-MM-dd HH.mm")).when(seconds < 45, "baru saja").when(seconds < 90, "semenit lalu")
        .when(minutes < 60, said(minutes, "menit")).when(hours < 24, said(hours, "jam")).when(days == 1, "kemarin").when(days < 7, said(days, "hari")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def size_text(size: Column) -> Column:
    """Bytes in the largest unit that they reach, with one decimal, written with a comma, unless it is 0."""
    said = lambda power, unit: F.concat(F.translate(F.regexp_replace(F.format_string("%.1f", size / 1024**power), r"\.0$", ""), ".", ","), F.lit(f" {unit}"))
    out = F.when(size.isNull(), "").when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(size < 1024 ** (power + 1), said(power, unit))
    return out.otherwise(said(4, "TB"))


def counted(n: Column, what: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {what}"))


def export_name(file_key: Column, observed_at: Column) -> Column:
    base = F.when(base_name(file_key).isin(".", "/"), "versi").otherwise(base_name(file_key))
    ext = extension(base)
    return F.concat(F.substr(base, F.lit(1), F.length(base) - F.length(ext)), F.lit(" ("), F.date_format(observed_at, "yyyy-MM-dd HH.mm"), F.lit(")"), ext)


def preview_source(path: Column) -> Column:
    """Which decoder a file's extension asks for; "" for none."""
    ext = F.lower(extension(base_name(path)))
    return (
        F.when(ext.isin(".png", ".jpg", ".jpeg", ".gif", ".webp"), "image").when(ext == ".kra", "kra").when(ext == ".psd", "psd")
        .when(ext.isin(".mp4", ".mov", ".m4v", ".webm", ".mkv", ".avi"), "video").otherwise("")
    )


def thumb_extension(format_: Column) -> Column:
    return F.when(format_ == "png", ".png").otherwise(".jpg")


def seek_seconds(duration_s: Column) -> Column:
    """Where a video's picture is taken: a tenth of its length, 2 s if that is unknown."""
    return F.when(duration_s > 0, duration_s / 10).otherwise(F.lit(2.0))


def fit_within(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Width and height in a square of `most`, in proportion and whole, never enlarged; 0 for an empty picture."""
    fits, none = (w <= most) & (h <= most), (w <= 0) | (h <= 0)
    part = lambda x, y: F.greatest(F.lit(1).cast("long"), F.floor(x * most / y))
    return F.when(none, 0).when(fits, w).when(w >= h, most).otherwise(part(w, h)), F.when(none, 0).when(fits, h).when(w >= h, part(h, w)).otherwise(most)


def like_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")
