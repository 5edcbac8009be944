"""Thumbnails and picture hashes in numpy, one file at a time inside Arrow batches.

Pictures are arrays of shape (height, width, 4), alpha not multiplied in.
Decoded here: PNG, Krita's merged image, and Photoshop's composite; other
formats have no decoder in this library and are "unsupported". Thumbnails are
PNG; there is no JPEG encoder here, so one over the byte budget is flattened
and stays PNG.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text
from folio.schema import PreviewLimits

PNG_MARK = b"\x89PNG\r\n\x1a\n"


class Unsupported(ValueError):
    """A kind of file that gets no picture."""


class Broken(ValueError):
    """A file of a known kind that can't be decoded."""


# --- PNG ---------------------------------------------------------------------


def png_header(data: bytes) -> tuple[int, int, int, int, int]:
    """Width, height, bit depth, colour type and interlacing, before anything is unpacked."""
    if data[:8] != PNG_MARK or data[12:16] != b"IHDR" or len(data) < 33:
        raise Unsupported("not a PNG")
    w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", data[16:29])
    return w, h, depth, kind, lace


#: Fixed values of the format: bit depths of each colour type, its channels, and the passes of an interlaced picture (first x, first y, step in x, step in y).
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(data: bytes, limits: PreviewLimits = PreviewLimits()) -> np.ndarray:
    """Any PNG; 16-bit samples keep their high byte, palette entries that are not there are black."""
    w, h, depth, kind, lace = png_header(data)
    if w < 1 or h < 1 or w * h > limits.pixels:
        raise Broken(f"{w}x{h} pixels")
    if depth not in DEPTHS.get(kind, ()) or lace > 1:
        raise Unsupported(f"depth {depth}, colour type {kind}")
    packed, palette, clear, at = [], None, None, 8
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IDAT":
            packed.append(body)
        elif name == b"PLTE":
            palette = body
        elif name == b"tRNS":
            clear = body
        elif name == b"IEND":
            break
        at += 12 + size
    samples = _samples(b"".join(packed), w, h, depth, CHANNELS[kind], PASSES if lace else ((0, 0, 1, 1),))
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        if palette is None or len(palette) % 3 or len(palette) > 768 or len(clear or b"") > 256:
            raise Broken("palette")
        colours = np.zeros((256, 4), np.uint8)
        colours[:, 3] = 255
        colours[: len(palette) // 3, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        colours[: len(clear or b""), 3] = np.frombuffer(clear or b"", np.uint8)
        return colours[samples[..., 0]]
    colour = samples[..., : 1 if kind in (0, 4) else 3]
    if clear is not None and kind in (0, 2):
        if len(clear) != 2 * CHANNELS[kind]:
            raise Broken("transparent colour")
        out[(colour == np.frombuffer(clear, ">u2")).all(-1), 3] = 0
    out[..., :3] = _as_bytes(colour, depth)
    if kind in (4, 6):
        out[..., 3] = _as_bytes(samples[..., -1], depth)
    return out


def _as_bytes(samples: np.ndarray, depth: int) -> np.ndarray:
    return (samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1))).astype(np.uint8)


def _samples(packed: bytes, w: int, h: int, depth: int, channels: int, passes: tuple) -> np.ndarray:
    """The samples of all passes at their places, as they are stored."""
    step = max(1, channels * depth // 8)  # how many bytes back a filter looks for the left neighbour
    shapes = [(-(-max(0, h - y) // dy), -(-max(0, w - x) // dx)) for x, y, dx, dy in passes]
    widths = [-(-pw * channels * depth // 8) for _, pw in shapes]
    total = sum(ph * (width + 1) for (ph, _), width in zip(shapes, widths, strict=True) if width)
    try:
        raw = zlib.decompressobj().decompress(packed, total)
    except zlib.error as e:
        raise Broken(str(e)) from e
    if len(raw) < total:
        raise Broken("truncated")
    out, at = np.zeros((h, w, channels), np.uint16 if depth == 16 else np.uint8), 0
    for (x, y, dx, dy), (ph, pw), width in zip(passes, shapes, widths, strict=True):
        if not ph or not pw:
            continue
        lines = np.frombuffer(raw, np.uint8, ph * (width + 1), at).reshape(ph, width + 1)
        at += lines.size
        plain = _unfiltered(lines[:, 0], lines[:, 1:].reshape(ph, width // step, step)).reshape(ph, width)
        if depth == 16:
            plain = plain.view(">u2")
        elif depth < 8:
            bits = np.unpackbits(plain, axis=1).reshape(ph, -1, depth)
            plain = bits[:, :pw] @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
        out[y::dy, x::dx] = plain.reshape(ph, pw, channels)
    return out


BAND = 256


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the filters, a band of rows at a time."""
    if kinds.max(initial=0) > 4:
        raise Broken(f"filter {kinds.max()}")
    out = np.zeros_like(lines)
    above = np.zeros_like(lines[0])
    for start in range(0, len(lines), BAND):
        part, band = kinds[start : start + BAND], lines[start : start + BAND]
        out[start : start + BAND] = _by_rows(part, band, above) if part.max() < 3 else _by_diagonals(part, band, above)
        above = out[start + len(band) - 1]
    return out


def _by_rows(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    out = np.empty_like(lines)
    for y, kind in enumerate(kinds.tolist()):
        line = lines[y]
        out[y] = above = line if kind == 0 else np.cumsum(line, 0, dtype=np.uint64).astype(np.uint8) if kind == 1 else line + above
    return out


def _by_diagonals(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A pixel waits for those to its left, above and between, so all with equal x + y are free at once."""
    h, w, step = lines.shape
    out = np.zeros((h + 1, w + 1, step), np.int16)
    out[0, 1:] = above
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def encode_png(picture: np.ndarray) -> bytes:
    opaque = not has_transparency(picture)
    body = picture[..., :3] if opaque else picture
    h, w, channels = body.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(body).reshape(h, w * channels)], 1).tobytes()
    piece = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return PNG_MARK + piece(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if opaque else 6, 0, 0, 0)) + piece(b"IDAT", zlib.compress(raw, 9)) + piece(b"IEND", b"")


# --- containers --------------------------------------------------------------


def decode_kra(data: bytes, limits: PreviewLimits = PreviewLimits()) -> np.ndarray:
    """The merged image inside a Krita archive, read no further than its limit whatever the archive claims."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Broken(str(e)) from e
    for info in archive.infolist()[: limits.zip_entries]:
        if f"/{info.filename.lower()}".endswith("/mergedimage.png"):
            with archive.open(info) as f:
                raw = f.read(limits.merged_bytes + 1)
            if len(raw) > limits.merged_bytes:
                raise Broken("merged image over its limit")
            return decode_png(raw, limits)
    raise Broken("no merged image")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Broken("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")


def decode_psd(data: bytes, limits: PreviewLimits = PreviewLimits()) -> np.ndarray:
    """The flattened composite of a Photoshop file: version 1, 8 bits, grey or RGB, raw or run-length packed."""
    r = _Reader(data)
    if data[:4] != b"8BPS":
        raise Unsupported("not a PSD")
    r.take(4)
    version = r.number(2)
    if version != 1:
        raise Unsupported(f"version {version}")
    r.take(6)
    channels, h, w, depth, mode = r.number(2), r.number(4), r.number(4), r.number(2), r.number(2)
    if not 1 <= channels <= limits.psd_channels or not 1 <= w <= limits.psd_edge or not 1 <= h <= limits.psd_edge:
        raise Unsupported(f"{channels} channels of {w}x{h}")
    if w * h > limits.pixels:
        raise Broken(f"{w}x{h} pixels")
    wanted = {1: 1, 3: 3}.get(mode, 0)
    if depth != 8 or not wanted or channels < wanted:
        raise Unsupported(f"depth {depth}, mode {mode}")
    for _ in range(3):
        r.take(r.number(4))
    packing = r.number(2)
    if packing == 0:
        planes = [np.frombuffer(r.take(w * h), np.uint8) for _ in range(wanted)]
    elif packing == 1:
        sizes = np.frombuffer(r.take(2 * channels * h), ">u2").tolist()
        planes = [np.frombuffer(b"".join(unpack_bits(r.take(n), w) for n in sizes[c * h : (c + 1) * h]), np.uint8) for c in range(wanted)]
    else:
        raise Unsupported(f"compression {packing}")
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = np.stack([p.reshape(h, w) for p in planes], 2)
    return out


def unpack_bits(packed: bytes, want: int) -> bytes:
    """One run-length packed row of `want` bytes; a short one ends in white."""
    out, at = bytearray(), 0
    while at < len(packed) and len(out) < want:
        n = packed[at]
        at += 1
        if n < 128:
            if at >= len(packed):
                raise Broken("a literal run passes the row")
            out += packed[at : at + n + 1]
            at += n + 1
        elif n > 128:
            if at >= len(packed):
                raise Broken("a repeated run without its byte")
            out += packed[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:want]).ljust(want, b"\xff")


# --- scaling and hashing -----------------------------------------------------


def fit_within(w: int, h: int, most: int) -> tuple[int, int]:
    if w <= 0 or h <= 0:
        return 0, 0
    if max(w, h) <= most:
        return w, h
    return (most, max(1, h * most // w)) if w >= h else (max(1, w * most // h), most)


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1, dtype=np.int64) * size // parts
    return at[:-1], np.maximum(at[1:], at[:-1] + 1)


def box_sums(values: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values over a grid of boxes that covers them, and each box's number of values; by summed areas."""
    (y0, y1), (x0, x1) = _edges(values.shape[0], rows), _edges(values.shape[1], columns)
    area = np.zeros((values.shape[0] + 1, values.shape[1] + 1, *values.shape[2:]), np.int64)
    area[1:, 1:] = values.cumsum(0, dtype=np.int64).cumsum(1)
    sums = area[y1][:, x1] - area[y0][:, x1] - area[y1][:, x0] + area[y0][:, x0]
    return sums, (y1 - y0)[:, None] * (x1 - x0)[None, :]


def multiplied(picture: np.ndarray) -> np.ndarray:
    """The picture with its alpha multiplied into its colours (8 bits)."""
    out = picture.astype(np.int64)
    alpha = out[..., 3:] * 257
    out[..., :3] = ((out[..., :3] * 257) * alpha // 65535) >> 8
    return out


def scale_to_fit(picture: np.ndarray, most: int) -> np.ndarray:
    """The picture, colours multiplied by alpha, shrunk by box averages; never enlarged."""
    h, w = picture.shape[:2]
    dw, dh = fit_within(w, h, most)
    flat = multiplied(picture)
    if (dw, dh) == (w, h):
        return flat.astype(np.uint8)
    sums, n = box_sums(flat, dh, dw)
    return (sums // n[..., None]).astype(np.uint8)


def has_transparency(picture: np.ndarray) -> bool:
    return bool((picture[..., 3] < 255).any())


def on_white(scaled: np.ndarray) -> np.ndarray:
    """A multiplied picture over white."""
    out = scaled.astype(np.int64)
    out[..., :3] = np.minimum(out[..., :3] + (255 - out[..., 3:]), 255)
    out[..., 3] = 255
    return out.astype(np.uint8)


def unmultiplied(scaled: np.ndarray) -> np.ndarray:
    out, alpha = scaled.astype(np.int64), scaled[..., 3:].astype(np.int64)
    out[..., :3] = np.where(alpha > 0, np.minimum((out[..., :3] * 255) // np.maximum(alpha, 1), 255), 0)
    return out.astype(np.uint8)


def thumbnail(picture: np.ndarray, limits: PreviewLimits = PreviewLimits()) -> tuple[bytes, int, int, bool]:
    """PNG bytes, width, height, and whether transparency was flattened to stay in the budget."""
    scaled = scale_to_fit(picture, limits.edge)
    h, w = scaled.shape[:2]
    if has_transparency(scaled):
        data = encode_png(unmultiplied(scaled))
        if len(data) <= limits.png_bytes:
            return data, w, h, False
        return encode_png(on_white(scaled)), w, h, True
    return encode_png(scaled), w, h, False


def shrink_to_grey(picture: np.ndarray, size: int = 8) -> np.ndarray:
    """Box averages of the luma, whole numbers, as size * size cells in rows."""
    c = multiplied_16(picture)
    luma = (299 * c[..., 0] + 587 * c[..., 1] + 114 * c[..., 2]) // 1000 >> 8
    sums, n = box_sums(luma, size, size)
    return (sums // n).ravel()


def multiplied_16(picture: np.ndarray) -> np.ndarray:
    """16-bit colours with alpha multiplied in."""
    c = picture.astype(np.int64) * 257
    return c[..., :3] * c[..., 3:] // 65535


def phash(picture: np.ndarray) -> str:
    """64 bits, low byte first: which cells of the 8x8 grey picture reach the floor of their mean."""
    grey = shrink_to_grey(picture)
    return np.packbits(grey >= grey.sum() // len(grey), bitorder="little").tobytes().hex()


# --- over tables -------------------------------------------------------------

DECODERS = {"image": decode_png, "kra": decode_kra, "psd": decode_psd}
_PREVIEW = "file_hash string, status string, source string, width int, height int, bytes long, error string, format string, alpha_flattened boolean, phash string, data binary"


def make_preview(source: str, content: bytes, limits: PreviewLimits = PreviewLimits()) -> dict:
    """One file's preview; whatever goes wrong becomes its status."""
    row = {"status": "failed", "source": source, "width": 0, "height": 0, "bytes": 0, "error": "", "format": "", "alpha_flattened": False, "phash": "", "data": None}
    try:
        if source not in DECODERS:
            raise Unsupported(source or "unknown kind")
        if len(content) > limits.source_bytes:
            raise Broken("file over its limit")
        picture = DECODERS[source](content, limits)
        data, _, _, flattened = thumbnail(picture, limits)
        row |= {"status": "ok", "width": picture.shape[1], "height": picture.shape[0], "bytes": len(data), "format": "png", "alpha_flattened": flattened, "phash": phash(decode_png(data)), "data": data}
    except Unsupported as e:
        row |= {"status": "unsupported", "error": str(e)}
    except Exception as e:  # one hostile file must not end the job
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def generate(files: DataFrame, previews: DataFrame, limits: PreviewLimits = PreviewLimits()) -> DataFrame:
    """Preview rows and thumbnail data for files(file_hash, path, content) that no picture was tried for; one per content."""
    fresh = files.join(previews.select("file_hash"), "file_hash", "left_anti").select("file_hash", text.preview_source(F.col("path")).alias("source"), "content")
    first = fresh.groupBy("file_hash").agg(F.min("source").alias("source"), F.first("content").alias("content"))
    names = [p.split()[0] for p in _PREVIEW.split(", ")]

    def run(batches):
        for batch in batches:
            made = [{"file_hash": h, **make_preview(s, c or b"", limits)} for h, s, c in zip(*(batch.column(n).to_pylist() for n in ("file_hash", "source", "content")), strict=True)]
            yield pa.RecordBatch.from_pylist([{n: m[n] for n in names} for m in made], schema=_ARROW)

    return first.mapInArrow(run, _PREVIEW)


_ARROW = pa.schema([
    ("file_hash", pa.string()), ("status", pa.string()), ("source", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bytes", pa.int64()),
    ("error", pa.string()), ("format", pa.string()), ("alpha_flattened", pa.bool_()), ("phash", pa.string()), ("data", pa.binary()),
])


def hash_thumbnails(thumbs: DataFrame) -> DataFrame:
    """file_hash, phash of thumbs(file_hash, data); those that can't be decoded are left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for h, d in zip(batch.column("file_hash").to_pylist(), batch.column("data").to_pylist(), strict=True):
                try:
                    rows.append((h, phash(decode_png(d or b""))))
                except ValueError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["file_hash", "phash"])

    return thumbs.select("file_hash", "data").mapInArrow(run, "file_hash string, phash string")


def locate_thumbs(thumbs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The thumbnail of each of hashes(file_hash), a PNG before a JPEG; malformed hashes have none."""
    best = thumbs.groupBy("file_hash").agg(F.min_by("data", F.when(F.col("format") == "png", 0).otherwise(1)).alias("data"), F.min(F.when(F.col("format") == "png", 0).otherwise(1)).alias("_k"))
    asked = hashes.where(text.is_content_hash(F.col("file_hash")))
    return asked.join(best, "file_hash").select("file_hash", F.when(F.col("_k") == 0, "png").otherwise("jpeg").alias("format"), "data")
