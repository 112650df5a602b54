"""Images as pixel tables through Spark's image source (bytes are blue, green, red)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """origin, row, col, r, g, b in 0..1; gray images have equal channels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for origin, h, w, n, data in zip(f.origin, f.height, f.width, f.nChannels, f.data, strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n) / 255.0
                r, g, b = (a[..., 2], a[..., 1], a[..., 0]) if n >= 3 else (a[..., 0],) * 3
                for k in range(0, h, 256):
                    part = slice(k, min(h, k + 256))
                    rows = np.arange(part.start, part.stop)
                    yield pd.DataFrame({"origin": origin, "row": np.repeat(rows, w), "col": np.tile(np.arange(w), len(rows)), "r": r[part].ravel(), "g": g[part].ravel(), "b": b[part].ravel()})

    images = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return images.mapInPandas(run, "origin string, row long, col long, r double, g double, b double")
