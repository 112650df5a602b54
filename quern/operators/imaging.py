"""Images as pixel tables: filters, components and their properties."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.geometry import pixel_to_um
from quern.operators.graph import checkpointed, labelled
from quern.operators.order import numbered


def gray_mean(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3


def gray_weighted(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def saturation(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, (top - low) / top).otherwise(0.0)


def is_saturated(r: Column, g: Column, b: Column, least: float = 0.3, bright: float = 0.08) -> Column:
    return (saturation(r, g, b) > least) & (F.greatest(r, g, b) > bright)


def downsampled(pixels: DataFrame, step: int) -> DataFrame:
    return pixels.filter((F.col("row") % step == 0) & (F.col("col") % step == 0)).withColumn("row", (F.col("row") / step).cast("long")).withColumn("col", (F.col("col") / step).cast("long"))


def box_mean(pixels: DataFrame, radius: int, value: str = "value", *image: str) -> DataFrame:
    """local: the mean of the (2 radius + 1)-square around each pixel, clipped at the edges; two separable windows."""
    across = Window.partitionBy(*image, "row").orderBy("col").rowsBetween(-radius, radius)
    down = Window.partitionBy(*image, "col").orderBy("row").rowsBetween(-radius, radius)
    part = pixels.withColumn("_s", F.sum(value).over(across)).withColumn("_n", F.count(F.lit(1)).over(across))
    return part.withColumn("local", F.sum("_s").over(down) / F.sum("_n").over(down)).drop("_s", "_n")


def integral(pixels: DataFrame, value: str = "value") -> DataFrame:
    down = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("_c", F.sum(value).over(down)).withColumn("integral", F.sum("_c").over(across)).drop("_c")


def components(pixels: DataFrame, width: int) -> DataFrame:
    """4-connected components of the given foreground pixels: label is the smallest row * width + col.

    Runs of a row are the nodes, runs that overlap in the next row are linked, so rounds depend on
    the objects' shapes, not on their pixels.
    """
    in_row = Window.partitionBy("row").orderBy("col")
    runs = pixels.withColumn("_g", F.col("col") - F.row_number().over(in_row)).groupBy("row", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    runs = runs.select("row", "c0", "c1", (F.col("row").cast("long") * width + F.col("c0")).alias("node"))
    below = runs.select((F.col("row") - 1).alias("row"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("b"))
    edges = runs.join(below, "row").filter("c0 <= d1 and d0 <= c1").select(F.col("node").alias("a"), "b")
    labels = labelled(runs.select("node"), edges)
    of_run = runs.join(labels, "node").select("row", "c0", "c1", "label")
    return of_run.select("row", F.explode(F.sequence("c0", "c1")).alias("col"), "label")


def properties(labelled_pixels: DataFrame, value: str = "value", *by: str) -> DataFrame:
    """Per component: centroid, box, size, intensities, equivalent diameter and aspect."""
    out = labelled_pixels.groupBy(*by, "label").agg(F.count("*").alias("area_px"), F.avg("row").alias("centroid_y"), F.avg("col").alias("centroid_x"), (F.max("row") - F.min("row") + 1).alias("bbox_height"), (F.max("col") - F.min("col") + 1).alias("bbox_width"), F.max(value).alias("max_intensity"), F.avg(value).alias("mean_intensity"), F.sum(value).alias("integrated_intensity"))
    longer, shorter = F.greatest("bbox_height", "bbox_width"), F.greatest(F.least("bbox_height", "bbox_width"), F.lit(1))
    return out.withColumn("equivalent_diameter", 2 * F.sqrt(F.col("area_px") / math.pi)).withColumn("aspect_ratio", longer / shorter)


def auto_trim(objects: DataFrame, expected: int, size: str = "area_px") -> DataFrame:
    """With over 1.5 times the expected number, those at least as large as the one of rank round(1.3 expected)."""
    n = objects.count()
    if n <= 1.5 * expected:
        return objects
    cut = objects.orderBy(F.desc(size)).limit(max(1, round(1.3 * expected))).agg(F.min(size)).first()[0]
    return objects.filter(F.col(size) >= cut)


def quarter_turned(pixels: DataFrame, width: int) -> DataFrame:
    """The image turned by 90 degrees: its last column becomes the first row."""
    return pixels.select((width - 1 - F.col("col")).alias("row"), F.col("row").alias("col"), "value")


#: Values of a tile that are smoothed at once.
SMOOTHED = 1 << 20


def gaussian(tile: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian smoothing with mirrored edges.

    Mirrored, an axis of n repeats itself after 2 n, and so may the kernel, however wide: the work follows the tile.
    """
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    tile = tile.astype(float)
    for axis in (0, 1):
        n = tile.shape[axis]
        f = np.fft.rfft(np.bincount(np.arange(-r, r + 1) % (2 * n), k, 2 * n))
        lines = np.moveaxis(tile, axis, 0)
        step = max(1, SMOOTHED // n)
        for at in range(0, lines.shape[1], step):
            some = lines[:, at : at + step]
            lines[:, at : at + step] = np.fft.irfft(np.fft.rfft(np.concatenate([some, some[::-1]]), axis=0) * f[:, None], 2 * n, 0)[:n]
    return tile


def clipped_background(tile: np.ndarray, sigma: float, clip: float = 3.0, rounds: int = 10) -> np.ndarray:
    """tile minus its smooth background, negatives as 0; bright residuals are replaced by the background and smoothed again."""
    sigma = sigma * tile.shape[0] / 500
    background, before = gaussian(tile, sigma), -1
    for _ in range(rounds):
        residual = tile - background
        plain = residual < residual.mean() + clip * residual.std()
        if plain.sum() == before:
            break
        before = plain.sum()
        background = gaussian(np.where(plain, tile, background), sigma)
    return np.maximum(tile - background, 0)


def corrected(pixels: DataFrame, height: int, width: int, rows: int = 4, cols: int = 4, sigma: float = 30.0) -> DataFrame:
    """row, col, value with each tile's background taken off; a tile is one task's work, bounded by the grid. Rows and columns beyond the grid are 0."""
    th, tw = height // rows, width // cols
    tiled = pixels.withColumn("tile_row", (F.col("row") / th).cast("int")).withColumn("tile_col", (F.col("col") / tw).cast("int"))
    inside = tiled.filter((F.col("tile_row") < rows) & (F.col("tile_col") < cols))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, places = np.zeros((th, tw)), []
        for batch in batches:
            row, col, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "value"))
            places.append((row, col))
            tile[row % th, col % tw] = value
        tile = clipped_background(tile, sigma)
        for row, col in places:
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(col.astype(np.int64)), pa.array(tile[row % th, col % tw])], names=["row", "col", "value"])

    inside = inside.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"), "tile_row", "tile_col")
    done = inside.groupBy("tile_row", "tile_col").applyInArrow(one, "row long, col long, value double")
    rest = tiled.filter((F.col("tile_row") >= rows) | (F.col("tile_col") >= cols)).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.lit(0.0).alias("value"))
    return done.unionByName(rest)


def detected(pixels: DataFrame, width: int, threshold: float = 25.0, least: int = 20) -> DataFrame:
    """Objects of the whole image over the threshold, with at least so many pixels; they may cross tiles."""
    bright = pixels.filter(F.col("value") > threshold)
    objects = properties(components(bright, width).join(bright, ["row", "col"]))
    return objects.filter(F.col("area_px") >= least)


def tuned_threshold(pixels: DataFrame, width: int, target: int, least: int, low: float = 10.0, high: float = 100.0, rounds: int = 25, tolerance: int = 3) -> float:
    """Bisection on the number of objects."""
    best, gap = low, None
    for _ in range(rounds):
        mid = (low + high) / 2
        n = detected(pixels, width, mid, least).count()
        if gap is None or abs(n - target) < gap:
            best, gap = mid, abs(n - target)
        if gap <= tolerance:
            break
        low, high = (mid, high) if n > target else (low, mid)
    return round(best, 1)


def sized(objects: DataFrame, least_px: int = 15, least_um: float = 20.0, size: str = "feret_max_um") -> DataFrame:
    """Objects of enough pixels and, where the size is known in micrometres, of enough size."""
    return objects.filter((F.col("area_px") >= least_px) & (F.col(size) >= least_um))


def r_properties(labelled_pixels: DataFrame, value: str = "value", *by: str) -> DataFrame:
    """Per component: mean and extreme rows and columns, size and mean intensity; rows and columns count from 1."""
    out = labelled_pixels.groupBy(*by, "label").agg(F.count("*").alias("area_px"), F.avg(F.col("row") + 1).alias("cy"), F.avg(F.col("col") + 1).alias("cx"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.avg(value).alias("mean_intensity"))
    height, width = F.col("row_max") - F.col("row_min") + 1, F.col("col_max") - F.col("col_min") + 1
    return out.withColumn("bbox_h", height).withColumn("bbox_w", width)


def placed_objects(objects: DataFrame, height: int, width: int, bounds: tuple[float, float, float, float] | None, prefix: str, source: str, step: int = 1) -> DataFrame:
    """Particle columns of r_properties(): places in micrometres within the bounds (x_min, x_max, y_min, y_max), y upwards.

    Without bounds places stay pixels. Ids count in the order of labels.
    """
    x0, x1, y0, y1 = bounds or (0.0, float(width), 0.0, float(height))
    sx, sy = (x1 - x0) / width * step, (y1 - y0) / height * step
    x = pixel_to_um(F.col("cx"), x0, x1 - x0, width, step)
    y = pixel_to_um(F.col("cy"), y0, y1 - y0, height, step, flip=True) if bounds else pixel_to_um(F.col("cy"), y0, y1 - y0, height, step)
    top, low = F.greatest("bbox_h", "bbox_w") * max(sx, sy), F.least("bbox_h", "bbox_w") * max(sx, sy)
    out = objects.select("label", "area_px", x.alias("x_um"), y.alias("y_um"), (F.col("area_px") * sx * sy).alias("area_um2"), top.alias("major_um"), low.alias("minor_um"), low.alias("feret_min_um"), top.alias("feret_max_um"))
    ids = numbered(out, "_n", "label")
    return ids.select((F.col("_n") - 1).cast("long").alias("row_idx"), F.concat(F.lit(prefix), F.col("_n")).alias("particle_id"), "area_px", "x_um", "y_um", "area_um2", "major_um", "minor_um", "feret_min_um", "feret_max_um", F.lit(None).cast("string").alias("material"), F.lit(None).cast("double").alias("quality"), F.lit(source).alias("source_file"))


def extracted(pixels: DataFrame, height: int, width: int, bounds: tuple[float, float, float, float] | None = None, expected: int = 0, downsample: int = 1, radius: int = 15, offset: float = 25.0, least_px: int = 4) -> DataFrame:
    """Adaptive segmentation: objects that differ from their local mean by more than offset, as particles."""
    small = downsampled(pixels, downsample) if downsample > 1 else pixels
    across = -(-width // downsample)
    fg = box_mean(small, radius).filter(F.abs(F.col("value") - F.col("local")) > offset)
    found = r_properties(components(fg, across).join(fg, ["row", "col"])).filter(F.col("area_px") >= least_px)
    particles = placed_objects(found, height, width, bounds, "IMG_", "image", downsample)
    return auto_trim(particles, expected, "feret_max_um") if expected else particles


def extracted_by_saturation(pixels: DataFrame, height: int, width: int, bounds: tuple[float, float, float, float] | None = None, expected: int = 0) -> DataFrame:
    """Objects of saturated, not too dark colour (r, g, b in 0..1), as particles of at least 15 pixels and 20 micrometres."""
    fg = pixels.filter(is_saturated(F.col("r"), F.col("g"), F.col("b"))).withColumn("value", F.greatest("r", "g", "b"))
    found = r_properties(components(fg.select("row", "col"), width).join(fg, ["row", "col"])).filter("area_px >= 15")
    particles = sized(placed_objects(found, height, width, bounds, "LDIR_IMG_", "LDIR_image"))
    return auto_trim(particles, expected, "feret_max_um") if expected else particles


def mode_of(pixels: DataFrame, limit: float = 0.15) -> str:
    """saturation for images whose mean saturation is over the limit, else adaptive."""
    mean = pixels.agg(F.avg(saturation(F.col("r"), F.col("g"), F.col("b"))).alias("s")).first().s
    return "saturation" if (mean or 0.0) > limit else "adaptive"


def full_pipeline(gray: DataFrame, height: int, width: int, rows: int = 4, cols: int = 4, sigma: float = 30.0, threshold: float = 25.0, least: int = 20, target: int = 0) -> tuple[DataFrame, float]:
    """(objects, threshold used): background off by tile, one threshold for the image (tuned to target objects if that is
    over 0), components over tile edges, properties with the tile that each centroid is in."""
    flat = checkpointed(corrected(gray, height, width, rows, cols, sigma))
    used = tuned_threshold(flat, width, target, least) if target > 0 else threshold
    found = detected(flat, width, used, least)
    th, tw = height // rows, width // cols
    tile = lambda c, n, most: F.least(F.floor(F.col(c) / n), F.lit(most - 1)).cast("int")
    found = found.withColumn("tile_row", tile("centroid_y", th, rows)).withColumn("tile_col", tile("centroid_x", tw, cols))
    return found.withColumn("local_y", F.col("centroid_y") - F.col("tile_row") * th).withColumn("local_x", F.col("centroid_x") - F.col("tile_col") * tw), used


def third_image(pixels: DataFrame, height: int, width: int, bounds: tuple[float, float, float, float] | None = None, expected: int = 0) -> DataFrame:
    """Particles of the third instrument's image: the background pipeline first; if it finds none, by saturation or adaptively."""
    gray = pixels.select("row", "col", (gray_weighted(F.col("r"), F.col("g"), F.col("b")) * 255).alias("value"))
    found, _ = full_pipeline(gray, height, width, target=expected)
    found = found.select("label", "area_px", (F.col("centroid_y") + 1).alias("cy"), (F.col("centroid_x") + 1).alias("cx"), F.col("bbox_height").alias("bbox_h"), F.col("bbox_width").alias("bbox_w"))
    particles = placed_objects(found, height, width, bounds, "LDIR_IMG_", "LDIR_image")
    if particles.limit(1).count():
        return particles
    if mode_of(pixels) == "saturation":
        return extracted_by_saturation(pixels, height, width, bounds, expected)
    return extracted(gray, height, width, bounds, expected)


def processed_view(pixels: DataFrame, saturated: bool = False) -> DataFrame:
    """What the segmentation sees: the corrected value over its maximum in green, or the mask of saturated colour."""
    if saturated:
        return pixels.select("row", "col", is_saturated(F.col("r"), F.col("g"), F.col("b")).cast("double").alias("green"))
    top = pixels.agg(F.max("value").alias("top"))
    return pixels.crossJoin(F.broadcast(top)).select("row", "col", F.when(F.col("top") > 0, F.col("value") / F.col("top")).otherwise(0.0).alias("green"))


def blue_gray(r: Column, g: Column, b: Column) -> Column:
    return b


def to_eight_bit(c: Column) -> Column:
    """A 16-bit gray value as 0..255."""
    return c / 257


def seams(pixels: DataFrame, size: int, most: int = 8, axis: str = "row") -> DataFrame:
    """tiles, strength: how much the image's profile along an axis jumps at the edges of so many equal tiles."""
    line = pixels.groupBy(axis).agg(F.avg("value").alias("mean"))
    before = line.select((F.col(axis) + 1).alias(axis), F.col("mean").alias("last"))
    grid = pixels.sparkSession.createDataFrame([(n, i * (size // n)) for n in range(2, most + 1) for i in range(1, n)], f"tiles int, {axis} long")
    jumps = line.join(before, axis).join(F.broadcast(grid), axis)
    return jumps.groupBy("tiles").agg((F.sum(F.abs(F.col("mean") - F.col("last"))) / (F.col("tiles") - 1)).alias("strength"))
