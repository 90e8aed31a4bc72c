"""Checks of declared constraints and of stored content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, keys: list[str], primary: bool = False) -> DataFrame:
    """Keys with more than one row, with their number; for a primary key also keys with a null. A unique key's nulls differ from each other."""
    if not primary:
        df = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    found = df.groupBy(*keys).agg(F.count("*").alias("n"))
    null = F.expr(" OR ".join(f"`{k}` IS NULL" for k in keys)) if primary else F.lit(False)
    return found.where((F.col("n") > 1) | null)


def check_violations(df: DataFrame, definition: str) -> DataFrame:
    """Rows for which a check is false; null passes, as in SQL."""
    return df.where(~F.coalesce(F.expr(definition), F.lit(True)))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column_name, n) of the nulls in columns, in one scan."""
    sums = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, referenced: list[str]) -> DataFrame:
    """Child rows whose key is not null in any part and has no parent; the parent may be the child itself."""
    named = parent.select(*(F.col(r).alias(f"_parent_{k}") for k, r in enumerate(referenced)))
    on = [F.col(f"`{c}`") == F.col(f"_parent_{k}") for k, c in enumerate(columns)]
    whole = child.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)))
    return whole.join(named, on, "left_anti")


def broken_parts(expected: DataFrame, actual: DataFrame, at: list[str], hash_col: str) -> DataFrame:
    """Parts of a manifest whose recomputed hash differs or that are missing: at, expected and actual hash."""
    a = expected.select(*at, F.col(hash_col).alias("expected_hash"))
    b = actual.select(*at, F.col(hash_col).alias("actual_hash"))
    return a.join(b, at, "left").where(~F.col("expected_hash").eqNullSafe(F.col("actual_hash")))
