"""Differences between two versions of a table, and their application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import row_hash
from ..plans.shared import unused


def _op(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "I").when(new.isNull(), "D").when(old != new, "U")


def _refuse(names: list[str], own: set[str]) -> None:
    clash = {n for n in names if n.lower() in own}
    if clash:
        raise ValueError(f"columns named like those of a difference: {sorted(clash)}")


def _named(df: DataFrame, keys: list[str], side: str) -> list[Column]:
    return [F.col(f"`{k}`").alias(f"{side}{n}") for n, k in enumerate(keys)]


def diff_keyed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, op, old_hash, new_hash) of inserts, updates and deletes. Columns are compared by name, so a column that one
    side lacks makes every row an update. Null keys equal each other. Keys named op, old_hash or new_hash are refused; other columns may have any
    name. One shuffle of each side on the keys, which carry hashes only."""
    _refuse(keys, {"op", "old_hash", "new_hash"})
    a = old.select(*_named(old, keys, "a"), row_hash(old.schema).alias("old_hash"))
    b = new.select(*_named(new, keys, "b"), row_hash(new.schema).alias("new_hash"))
    same = reduce(lambda x, y: x & y, (F.col(f"a{n}").eqNullSafe(F.col(f"b{n}")) for n in range(len(keys))))
    # an inserted row's key is the new side's, all others' the old side's
    key = [F.when(F.col("old_hash").isNull(), F.col(f"b{n}")).otherwise(F.col(f"a{n}")).alias(k) for n, k in enumerate(keys)]
    both = a.join(b, same, "full_outer").withColumn("op", _op(F.col("old_hash"), F.col("new_hash"))).where("op IS NOT NULL")
    return both.select(*key, "op", "old_hash", "new_hash")


def diff_positional(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (batch_no, chunk_no, pos, op, old_hash, new_hash) of placed versions, by place. Rows beyond the new end are deletes."""
    at = ["batch_no", "chunk_no", "pos"]
    a = old.select(*at, F.col("row_hash").alias("old_hash"))
    b = new.select(*at, F.col("row_hash").alias("new_hash"))
    both = a.join(b, at, "full_outer").withColumn("op", _op(F.col("old_hash"), F.col("new_hash")))
    return both.where("op IS NOT NULL").select(*at, "op", "old_hash", "new_hash")


def diff_keyless(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (row_hash, op, n) of a multiset difference: one signed count per row content, aggregated before the shuffle, so that
    any number of equal rows is one row there."""
    a = old.select(row_hash(old.schema).alias("row_hash"), F.lit(-1).alias("d"))
    b = new.select(row_hash(new.schema).alias("row_hash"), F.lit(1).alias("d"))
    net = a.union(b).groupBy("row_hash").agg(F.sum("d").alias("d")).where("d <> 0")
    return net.select("row_hash", F.when(F.col("d") > 0, "I").otherwise("D").alias("op"), F.abs("d").alias("n"))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A keyed difference that can be applied: keys, op and the new rows' other columns (null for deletes). Tables with a column op are refused."""
    _refuse(new.columns, {"op"})
    found = diff_keyed(old, new, keys).select(*keys, "op")
    rest = [c for c in new.columns if c not in keys]
    there = new.select(*_named(new, keys, "b"), *(F.col(f"`{c}`") for c in rest))
    joined = found.join(there, _same(found, keys), "left")
    return joined.select(*(F.col(f"`{k}`") for k in keys), "op", *(F.col(f"`{c}`") for c in rest))


def _same(df: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (df[f"`{k}`"].eqNullSafe(F.col(f"b{n}")) for n, k in enumerate(keys)))


def apply_changes(base: DataFrame, diff: DataFrame, keys: list[str]) -> DataFrame:
    """base with the changes made: rows whose key is in diff go, and those of diff that are no deletes come. Null keys equal each other."""
    kept = base.join(diff.select(*_named(diff, keys, "b")), _same(base, keys), "left_anti")
    return kept.unionByName(diff.where("op <> 'D'").drop("op"), allowMissingColumns=True)


def missing_targets(base: DataFrame, diff: DataFrame, keys: list[str]) -> DataFrame:
    """Updates and deletes whose row base lacks: none, unless diff belongs to another version."""
    return diff.where("op IN ('U', 'D')").join(base.select(*keys), keys, "left_anti").select(*keys, "op")


def fold_chain(diffs: list[DataFrame], keys: list[str]) -> DataFrame:
    """One change for each key out of a chain of differences, the last one. An insert that a later delete undoes stays a delete,
    which does nothing."""
    numbered = [d.withColumn("_seq", F.lit(k)) for k, d in enumerate(diffs)]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), numbered)
    rest = [c for c in every.columns if c not in keys]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_last"))
    return last.select(*keys, "_last.*").drop("_seq")


def tombstones(rows: DataFrame) -> DataFrame:
    """The difference of a chunk to nothing."""
    return rows.select("batch_no", "chunk_no", "pos", F.lit("D").alias("op"), F.col("row_hash").alias("old_hash"), F.lit(None).cast("string").alias("new_hash"))


def fresh(rows: DataFrame) -> DataFrame:
    """The difference of nothing to a chunk."""
    return rows.select("batch_no", "chunk_no", "pos", F.lit("I").alias("op"), F.lit(None).cast("string").alias("old_hash"), F.col("row_hash").alias("new_hash"))


def changed_parts(old: DataFrame, new: DataFrame, at: list[str], hash_col: str) -> DataFrame:
    """Chunks or batches of two manifests whose hashes differ: at, op, old and new hash."""
    a = old.select(*at, F.col(hash_col).alias("old_hash"))
    b = new.select(*at, F.col(hash_col).alias("new_hash"))
    both = a.join(b, at, "full_outer").withColumn("op", _op(F.col("old_hash"), F.col("new_hash")))
    return both.where("op IS NOT NULL").select(*at, "op", "old_hash", "new_hash")


def pruned_diff(old: DataFrame, new: DataFrame, chunk_changes: DataFrame) -> DataFrame:
    """Positional difference of the changed chunks alone."""
    at = ["batch_no", "chunk_no"]
    touched = chunk_changes.select(*at)
    return diff_positional(old.join(touched, at, "left_semi"), new.join(touched, at, "left_semi"))


def apply_positional(base: DataFrame, diff: DataFrame, new: DataFrame) -> DataFrame:
    """Placed rows of base with a positional difference made: places that diff deletes or updates go, and for those it updates or inserts the rows
    of new with that place and hash come. base and new: placed rows with the same columns."""
    at = ["batch_no", "chunk_no", "pos"]
    kept = base.join(diff.where("op <> 'I'").select(*at), at, "left_anti")
    come = diff.where("op <> 'D'").select(*at, F.col("new_hash").alias("row_hash"))
    return kept.unionByName(new.join(come, [*at, "row_hash"], "left_semi").select(kept.columns))


def stale_places(base: DataFrame, diff: DataFrame) -> DataFrame:
    """Places that diff updates or deletes where base has no row or another one than diff says: none, unless diff belongs to another version."""
    at = ["batch_no", "chunk_no", "pos"]
    have = base.select(*at, F.col("row_hash").alias("have"))
    both = diff.where("op <> 'I'").select(*at, "old_hash").join(have, at, "left")
    return both.where(~F.col("old_hash").eqNullSafe(F.col("have"))).select(*at, "old_hash", F.col("have").alias("found_hash"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks and the reverse, as often as one side has them more often; nulls are equal. side is removed or added."""
    columns = [F.col(f"`{c}`") for c in a.columns]
    n, side = unused(a, "_n", "side")
    both = a.select(*columns, F.lit(-1).alias(n)).unionByName(b.select(*columns, F.lit(1).alias(n)))
    net = both.groupBy(*columns).agg(F.sum(n).alias(n)).where(F.col(n) != 0)
    net = net.withColumn(side, F.when(F.col(n) < 0, "removed").otherwise("added"))
    return net.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.abs(n).cast("int")))).drop(n)
