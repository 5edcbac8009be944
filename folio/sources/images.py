"""Pictures that Spark's own image reader decodes: PNG, JPEG, GIF and BMP."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import previews
from folio.schema import PreviewLimits

_COLUMNS = "path string, width int, height int, phash string, data binary"


def as_picture(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The reader's rows of (blue, green, red[, alpha]) or grey bytes as red, green, blue, alpha."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = raw[..., [2, 1, 0]] if channels >= 3 else raw[..., :1]
    if channels == 4:
        out[..., 3] = raw[..., 3]
    return out


def pictures(spark: SparkSession, path: str, limits: PreviewLimits = PreviewLimits()) -> DataFrame:
    """path, width, height, phash and thumbnail of the readable pictures under path; others are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    rows = rows.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    rows = rows.where(F.col("height").cast("long") * F.col("width") <= limits.pixels)

    def run(batches):
        for batch in batches:
            for name, h, w, n, data in zip(*(batch.column(c).to_pylist() for c in ("path", "height", "width", "nChannels", "data")), strict=True):
                picture = as_picture(h, w, n, data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([previews.phash(picture)]), pa.array([previews.thumbnail(picture, limits)[0]], pa.binary())], ["path", "width", "height", "phash", "data"])

    return rows.mapInArrow(run, _COLUMNS)
