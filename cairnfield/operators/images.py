"""Images to 160 numbers: structure, layout, colour histogram and aspect, as one unit vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.operators.catalog import MAX_PIXELS
from cairnfield.session import cut_lineage

# Block sizes, block weights, luma and chroma coefficients, histogram bins and colour thresholds.
DIM = 160
STRUCTURE_WEIGHT, LAYOUT_WEIGHT, HISTOGRAM_WEIGHT, ASPECT_WEIGHT = 1.0, 1.0, 0.7, 0.3
LUMA = np.array([0.299, 0.587, 0.114])
CHROMA_BLUE = np.array([-0.168736, -0.331264, 0.5])
CHROMA_RED = np.array([0.5, -0.418688, -0.081312])
STRUCTURE_SIDE, STRUCTURE_KEEP = 32, 8
COLOUR_SIDE, GRID = 64, 4
HUE_BINS, SATURATION_BINS, VALUE_BINS = 12, 3, 12
MIN_SATURATION, MIN_VALUE = 0.12, 0.10

COSINES = np.cos(
    np.pi
    * np.outer(np.arange(STRUCTURE_KEEP), 2 * np.arange(STRUCTURE_SIDE) + 1)
    / (2 * STRUCTURE_SIDE)
)


def _resampler(source: int, target: int) -> np.ndarray:
    """Rows of triangle-filter weights that take ``source`` samples to ``target``."""
    scale = source / target
    support = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale - 0.5
    weight = np.maximum(0.0, 1.0 - np.abs(np.arange(source)[None, :] - centre[:, None]) / support)
    return weight / weight.sum(1, keepdims=True)


def _resized(pixels: np.ndarray, side: int) -> np.ndarray:
    rows, cols = _resampler(pixels.shape[0], side), _resampler(pixels.shape[1], side)
    mixed = np.einsum("yh,hwc->ywc", rows, pixels.astype(np.float64))
    return np.clip(np.rint(np.einsum("xw,ywc->yxc", cols, mixed)), 0, 255)


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum())
    return v / length if length > 1e-12 else v


def _hellinger(bins: np.ndarray, n: int) -> np.ndarray:
    counts = np.bincount(bins, minlength=n).astype(np.float64)
    return np.sqrt(counts / counts.sum()) if counts.sum() else counts


def _histogram(rgb: np.ndarray) -> np.ndarray:
    flat = rgb.reshape(-1, 3)
    top, low = flat.max(1), flat.min(1)
    delta = top - low
    safe = np.where(delta > 0, delta, 1.0)
    r, g, b = flat.T
    hue = np.select(
        [delta <= 0, top == r, top == g],
        [0.0, 60 * np.mod((g - b) / safe, 6), 60 * ((b - r) / safe + 2)],
        60 * ((r - g) / safe + 4),
    )
    saturation = np.where(top > 0, delta / np.where(top > 0, top, 1.0), 0.0)
    chromatic = (saturation > MIN_SATURATION) & (top > MIN_VALUE)
    hue_bin = np.minimum((np.mod(hue, 360) / (360 / HUE_BINS)).astype(int), HUE_BINS - 1)
    sat_bin = np.minimum((saturation * SATURATION_BINS).astype(int), SATURATION_BINS - 1)
    val_bin = np.minimum((top * VALUE_BINS).astype(int), VALUE_BINS - 1)
    joint = (hue_bin * SATURATION_BINS + sat_bin)[chromatic]
    return np.concatenate([_hellinger(joint, HUE_BINS * SATURATION_BINS), _hellinger(val_bin, VALUE_BINS)])


def _oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Camera orientation 1..8 undone; other values leave the picture as it is."""
    turned = {5: 3, 6: 3, 7: 1, 8: 1, 3: 2}.get(orientation, 0)
    pixels = np.rot90(pixels, turned)
    if orientation in (2, 5, 7):
        return pixels[:, ::-1]
    return pixels[::-1] if orientation == 4 else pixels


def picture_vector(pixels: np.ndarray) -> np.ndarray:
    """The 160 features of a height x width x 3 RGB array of 0..255."""
    height, width = pixels.shape[:2]
    small = _resized(pixels, STRUCTURE_SIDE) @ LUMA
    structure = (COSINES @ small @ COSINES.T).reshape(-1)[1:]
    rgb = _resized(pixels, COLOUR_SIDE) / 255.0
    planes = rgb @ np.stack([LUMA, CHROMA_BLUE, CHROMA_RED], 1)
    cell = COLOUR_SIDE // GRID
    layout = planes.reshape(GRID, cell, GRID, cell, 3).mean((1, 3)).reshape(-1)
    aspect = np.clip(np.log2(width / height), -2, 2) / 2
    parts = [
        STRUCTURE_WEIGHT * _unit(structure),
        LAYOUT_WEIGHT * _unit(layout),
        HISTOGRAM_WEIGHT * _unit(_histogram(rgb)),
        [ASPECT_WEIGHT * aspect],
    ]
    return _unit(np.concatenate(parts))


FEATURE_SCHEMA = "path string, width int, height int, vec array<float>, error string"


def featurize_images(
    images: DataFrame, orientation_col: str | None = None, max_pixels: int = MAX_PIXELS
) -> tuple[DataFrame, DataFrame]:
    """160-d vectors of decoded images, and the pictures that could not be used with an ``error``.

    ``images`` has the ``image`` struct of Spark's image source (BGR bytes; width -1 marks an undecodable file).
    """
    turn = F.col(orientation_col).cast("int") if orientation_col else F.lit(1)
    flat = images.select(
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
        F.coalesce(turn, F.lit(1)).alias("orientation"),
    )

    def one(row) -> tuple[int, int, list]:
        if row.width <= 0 or row.height <= 0:
            raise ValueError("undecodable image")
        if row.width * row.height > max_pixels:
            raise ValueError("pixel cap")
        raw = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
        rgb = raw[:, :, 2::-1] if row.channels >= 3 else np.repeat(raw, 3, axis=2)
        rgb = _oriented(rgb, int(row.orientation))
        return rgb.shape[1], rgb.shape[0], [float(x) for x in picture_vector(rgb)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    width, height, vec = one(row)
                    out.append((row.path, width, height, vec, None))
                except Exception as e:  # a bad picture goes to quarantine, the batch goes on
                    out.append((row.path, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "vec", "error"]).astype(
                {"width": "Int32", "height": "Int32"}
            )

    # Results and failures are two parts of one written pass.
    done = cut_lineage(flat.mapInPandas(run, FEATURE_SCHEMA))
    ok = done.filter(F.col("error").isNull()).drop("error")
    return ok, done.filter(F.col("error").isNotNull()).select("path", "error")
