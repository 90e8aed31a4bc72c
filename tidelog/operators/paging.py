"""Pages of a table: after a key, or by offset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The first rows in key order, or the first after a key; the comparison is that of whole key rows."""
    if after is not None:
        later = F.lit(False)
        for k in reversed(range(len(keys))):
            later = (F.col(keys[k]) > F.lit(after[k])) | ((F.col(keys[k]) == F.lit(after[k])) & later)
        # the first key alone reaches the scan as a pushed filter
        df = df.where((F.col(keys[0]) >= F.lit(after[0])) & later)
    return df.orderBy(*keys).limit(size)


def offset_page(df: DataFrame, size: int, offset: int, order: list[str] | None = None) -> DataFrame:
    """Rows by place; without an order all columns give one."""
    return df.orderBy(*(order or df.columns)).offset(offset).limit(size)


def next_cursor(page: DataFrame, keys: list[str]) -> DataFrame:
    """One row with the last key of a page, after which the next page starts; none for an empty page."""
    last = page.agg(F.max(F.struct(*keys)).alias("last")).where("last IS NOT NULL")
    return last.select("last.*")
