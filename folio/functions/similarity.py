"""Signals that two files are one work, and their score, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import text
from folio.schema import Weights


def _bytes(s: Column) -> Column:
    """The UTF-8 bytes of a text as characters, so that lengths and distances count bytes."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def byte_levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(_bytes(a), _bytes(b))


def name_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - byte_levenshtein(a, b).cast("double") / longest))


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def gap_closeness(gap: Column, window_s: float) -> Column:
    """1 for no gap (in microseconds), falling to 0 at the window."""
    if window_s <= 0:
        return F.lit(0.0)
    return F.when(gap >= int(window_s * 1e6), 0.0).otherwise(1 - gap.cast("double") / (window_s * 1e6))


def time_closeness(a: Column, b: Column, window_s: float) -> Column:
    return gap_closeness(F.abs(micros(a) - micros(b)), window_s)


def is_phash(h: Column) -> Column:
    return F.coalesce(h.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))


def phash_bits(h: Column) -> Column:
    """The 64 bits as a long, null unless h is 16 hexadecimal digits."""
    return F.when(is_phash(h), F.conv(h, 16, -10).cast("long"))


def hamming_bits(a: Column, b: Column) -> Column:
    """Differing bits of two phash_bits(); -1 if either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(-1))


def hamming(a: Column, b: Column) -> Column:
    return hamming_bits(phash_bits(a), phash_bits(b))


def image_closeness(distance: Column, similar: int, different: int) -> Column:
    return F.when(distance <= similar, 1.0).when(distance >= different, 0.0).otherwise(1 - (distance - similar).cast("double") / (different - similar))


def grid_mean(grid: Column) -> Column:
    return F.floor(F.aggregate(grid, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(grid))


def grid_phash(grid: Column, mean: Column) -> Column:
    """16 hexadecimal digits, low byte first, of the 64 cells that reach the mean. Give the mean as a column made before."""
    bits = F.transform(grid, lambda x: (x >= mean).cast("int"))
    digit = lambda at: F.hex(sum((F.element_at(bits, at + k + 1) * (1 << k) for k in range(1, 4)), F.element_at(bits, at + 1)))
    return F.lower(F.concat(*(d for byte in range(8) for d in (digit(8 * byte + 4), digit(8 * byte)))))


def score(a_name: Column, b_name: Column, a_time: Column, b_time: Column, a_bits: Column, b_bits: Column, a_path: Column, b_path: Column, w: Weights, name_score: Column | None = None) -> dict[str, Column]:
    """name_score, time_score, image_score, has_image, distance, vetoed and total of a pair of files."""
    name = name_similarity(a_name, b_name) if name_score is None else name_score
    same_work = (a_name == b_name) & text.same_folder_tree(a_path, b_path)
    return signals(name, F.abs(micros(a_time) - micros(b_time)), hamming_bits(a_bits, b_bits), same_work, w)


def signals(name: Column, gap: Column, distance: Column, same_work: Column, w: Weights) -> dict[str, Column]:
    """The same from the name score, the gap in microseconds, the differing bits (-1: no pictures) and whether name and folder tree are one."""
    time = gap_closeness(gap, w.time_window_s)
    has_image = distance >= 0
    image = F.when(has_image, image_closeness(distance, w.similar_image, w.different_image)).otherwise(0.0)
    vetoed = has_image & (distance > w.different_image) & ~same_work
    total = F.when(vetoed, 0.0).when(has_image, w.name * name + w.time * time + w.image * image).otherwise((w.name * name + w.time * time) / (w.name + w.time))
    return {"name_score": name, "time_score": time, "image_score": image, "has_image": has_image, "distance": distance, "vetoed": vetoed, "total": total}
