"""Signatures of raw pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def signature(pixels: bytes, width: int = 16) -> tuple[list[float], list[float]]:
    """A gray thumbnail of ``width`` squared means, and a histogram of four levels for each of red, green and blue."""
    rgb = np.frombuffer(pixels[: len(pixels) // 3 * 3], np.uint8).reshape(-1, 3)
    gray = rgb.astype(float) @ np.array([0.299, 0.587, 0.114])
    cells = np.array_split(gray, width * width)
    levels = (rgb // 64).astype(int) @ np.array([16, 4, 1])
    histogram = np.bincount(levels, minlength=64) / max(len(rgb), 1)
    return [round(float(c.mean()) / 255, 6) if len(c) else 0.0 for c in cells], [round(float(h), 6) for h in histogram]


def perceptual_signature(width: int = 16):
    """A column function from binary pixels to ``gray`` and ``histogram``."""

    @F.pandas_udf("gray array<double>, histogram array<double>")
    def of(pixels: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signature(p or b"", width) for p in pixels], columns=["gray", "histogram"])

    return of
