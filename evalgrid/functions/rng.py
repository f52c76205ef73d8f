"""Randomness that any SQL engine reproduces: the first 32 bits of an md5 of the parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, *parts: Column | str) -> Column:
    """A whole number from 0 to 2**32 - 1 that depends on the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def draw_sql(seed: int | str, *parts: str) -> str:
    """The same number in DuckDB's SQL."""
    listed = ", ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"('0x' || substr(md5(concat_ws('|', {listed})), 1, 8))::BIGINT"
