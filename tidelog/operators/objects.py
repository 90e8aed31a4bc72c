"""Catalog objects: definitions folded from catalog rows, field differences, states between snapshots, and restore order."""

from __future__ import annotations

import re
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import save

#: Order in which a restore makes objects.
PHASES = {"sequence": 1, "table": 2, "rows": 3, "foreign key": 4, "index": 4, "routine": 5}
#: Column types whose order pages can follow, without length or precision: fixed values.
COMPARABLE = ["smallint", "integer", "bigint", "decimal", "numeric", "real", "double precision", "character", "character varying", "text", "uuid", "date",
              "timestamp without time zone", "timestamp with time zone", "time without time zone", "time with time zone", "inet", "cidr"]
#: Other names of these types.
ALIASES = {"int": "integer", "varchar": "character varying", "char": "character", "timestamp": "timestamp without time zone", "time": "time without time zone"}


def columns_of(df: DataFrame, table: str) -> DataFrame:
    """Rows (table_name, position, name, type, nullable) of a DataFrame's schema, positions from 1."""
    rows = [(table, k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "table_name string, position int, name string, type string, nullable boolean")


def _ordered(value: str, by: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col(value).alias("v")))), lambda x: x.getField("v"))


def fold_constraints(rows: DataFrame) -> DataFrame:
    """One row for each constraint of (table_name, name, type, ordinal, column_name, definition); columns in key order;
    generated not-null checks are left out."""
    rows = rows.where(~F.col("name").rlike("_not_null$"))
    rows = rows.groupBy("table_name", "name", "type").agg(F.array_join(_ordered("column_name", "ordinal"), ",").alias("columns"), F.max("definition").alias("definition"))
    return rows


def fold_foreign_keys(rows: DataFrame) -> DataFrame:
    """One row for each key of (table_name, name, ordinal, column_name, referenced_table, referenced_column); pairs keep their order."""
    return rows.groupBy("table_name", "name", "referenced_table").agg(
        F.array_join(_ordered("column_name", "ordinal"), ",").alias("columns"), F.array_join(_ordered("referenced_column", "ordinal"), ",").alias("referenced_columns"))


def fold_indexes(rows: DataFrame, constraints: DataFrame) -> DataFrame:
    """Indexes that back no constraint, from rows (table_name, name, method, is_unique, predicate, columns array)."""
    free = rows.join(constraints.select("table_name", "name").distinct(), ["table_name", "name"], "left_anti")
    each = free.select("table_name", "name", "method", "is_unique", "predicate", F.posexplode("columns").alias("ordinal", "column_name"))
    return each.groupBy("table_name", "name", "method", "is_unique", "predicate").agg(F.array_join(_ordered("column_name", "ordinal"), ",").alias("columns"))


def primary_key(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Tables and key columns of primary keys that pages can follow: all their types are comparable."""
    base = F.trim(F.regexp_replace(F.lower("type"), r"\s*\([^)]*\)", ""))
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), base), base)
    keys = constraints.where("type = 'PRIMARY KEY'").select("table_name", "name", "ordinal", F.col("column_name"))
    types = columns.select("table_name", F.col("name").alias("column_name"), base.isin(COMPARABLE).alias("ok"))
    each = keys.join(types, ["table_name", "column_name"], "left")
    folded = each.groupBy("table_name", "name").agg(F.array_join(_ordered("column_name", "ordinal"), ",").alias("columns"), F.min(F.coalesce("ok", F.lit(False))).alias("ok"))
    return folded.where("ok").drop("ok")


def comparable_key(types: dict[str, str], key: list[str]) -> bool:
    """Whether pages can follow a key, by the types of a table's columns."""
    base = lambda t: re.sub(r"\s*\([^)]*\)", "", t.lower()).strip()
    return bool(key) and all(c in types and ALIASES.get(base(types[c]), base(types[c])) in COMPARABLE for c in key)


def merge_definitions(base: DataFrame, removed: DataFrame, added: DataFrame, order: list[str]) -> DataFrame:
    """A definition with the removed entries taken out and the added ones put in."""
    on = [base[c].eqNullSafe(removed[c]) for c in base.columns]
    return base.join(removed, on, "left_anti").unionByName(added).orderBy(*order)


def field_patch(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """For objects in both versions: each field's new value and whether it changed, so that a field that became null differs
    from one that did not change."""
    fields = [c for c in old.columns if c != key]
    both = old.alias("a").join(new.alias("b"), key)
    out = [F.col(key)]
    for f in fields:
        differs = ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
        out += [F.when(differs, F.col(f"b.{f}")).alias(f), differs.alias(f"{f}_changed")]
    return both.select(*out)


def apply_patch(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    fields = [c for c in base.columns if c != key]
    both = base.alias("a").join(patch.alias("p"), key, "left")
    return both.select(key, *(F.when(F.coalesce(f"p.{f}_changed", F.lit(False)), F.col(f"p.{f}")).otherwise(F.col(f"a.{f}")).alias(f) for f in fields))


def object_status(last: DataFrame, now: DataFrame) -> DataFrame:
    """new, changed, unchanged or dropped for each (kind, name) of two manifests (kind, name, ref)."""
    a = last.select("kind", "name", F.regexp_replace("ref", "^diffs/", "").alias("old_hash"))
    b = now.select("kind", "name", F.regexp_replace("ref", "^diffs/", "").alias("new_hash"))
    both = a.join(b, ["kind", "name"], "full_outer")
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "dropped").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    return both.select("kind", "name", status.alias("status"))


def dependency_levels(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (name, level): 0 without dependencies, else one above the highest; nodes in or behind a cycle, or that need a missing one, have a null
    level. edges: (name, needs). Each round settles what needs only settled nodes, so a diamond is walked once; rounds
    end when one settles nothing. Nodes without a name have a null level. What a round settles is saved; edges to settled nodes
    are no longer looked at."""
    nodes, edges = nodes.select("name").distinct(), edges.select("name", "needs").distinct()
    waiting = save(nodes.where("name IS NOT NULL"), "waiting")
    open_edges, done = save(edges, "edges"), []
    for level in count():
        ready = save(waiting.join(open_edges, "name", "left_anti"), "ready")
        if ready.isEmpty():
            break
        done.append(ready.withColumn("level", F.lit(level)))
        waiting = save(waiting.join(ready, "name", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        open_edges = save(open_edges.join(ready.select(F.col("name").alias("needs")), "needs", "left_anti").select("name", "needs"), "edges")
    settled = reduce(DataFrame.union, done) if done else spark.createDataFrame([], "name string, level int")
    return nodes.join(settled, "name", "left")


def missing_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("name").alias("needs")), "needs", "left_anti").select("name", "needs")


def restore_plan(objects: DataFrame) -> DataFrame:
    """Objects (kind, name) with the phase in which a restore makes them."""
    phase = F.coalesce(*(F.when(F.col("kind") == k, F.lit(p)) for k, p in PHASES.items()))
    return objects.select("kind", "name", phase.alias("phase"))
