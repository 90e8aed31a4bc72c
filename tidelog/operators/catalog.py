"""Catalog objects in one form for all kinds: (kind, name, fields, hash).

fields maps each field of a kind to its entries, JSON texts: one for a plain field, any number for a list. So one difference and one
application serve columns, constraints, keys, indexes, sequences and routines alike, and a difference tells a field that became null from one
that did not change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_definition

_BIG = "decimal(38,0)"
#: Fields of each kind and their types; arrays are lists of entries, in the order of their first field.
KINDS = {
    "sequence": {"type": "string", "start": _BIG, "min": _BIG, "max": _BIG, "increment": _BIG, "cycle": "boolean", "last_value": _BIG, "is_called": "boolean"},
    "table": {
        "columns": "array<struct<position:bigint,name:string,type:string,nullable:boolean,default_value:string>>",
        "constraints": "array<struct<name:string,type:string,columns:array<string>,definition:string>>",
        "foreign_keys": "array<struct<name:string,columns:array<string>,referenced_table:string,referenced_columns:array<string>,update_action:string,delete_action:string>>",
        "indexes": "array<struct<name:string,method:string,columns:array<string>,is_unique:boolean,predicate:string>>"},
    "function": {"language": "string", "volatility": "string", "dependencies": "array<string>", "parameters": "string", "return_type": "string", "tag": "string", "definition": "string"},
    "procedure": {"language": "string", "dependencies": "array<string>", "parameters": "string", "tag": "string", "definition": "string"},
    "trigger": {"definition": "string"},
}
ROUTINES = ("function", "procedure", "trigger")
OBJECT = "kind string, name string, fields map<string,array<string>>, hash string"
DELTA = "map<string,struct<removed:array<string>,added:array<string>>>"


def _json(x: Column) -> Column:
    return F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})


def _entries(value: Column, kind: str) -> Column:
    if kind.startswith("array<"):
        return F.array_sort(F.transform(F.coalesce(value, F.from_json(F.lit("[]"), kind)), _json))
    return F.array(_json(value))


def object_hash(kind: Column, name: Column, fields: Column) -> Column:
    """Content id of an object."""
    return F.sha2(F.to_json(F.struct(kind.alias("kind"), name.alias("name"), F.array_sort(F.map_entries(fields)).alias("fields")), {"ignoreNullFields": "false"}), 256)


def pack(df: DataFrame, kind: str) -> DataFrame:
    """Objects of rows (name, the kind's fields); fields that df lacks are null or empty."""
    value = lambda f, t: F.col(f"`{f}`").cast(t) if f in df.columns else F.lit(None).cast(t)
    fields = F.map_from_entries(F.array(*(F.struct(F.lit(f), _entries(value(f, t), t)) for f, t in sorted(KINDS[kind].items()))))
    out = df.select(F.lit(kind).alias("kind"), "name", fields.alias("fields"))
    return out.withColumn("hash", object_hash(F.col("kind"), F.col("name"), F.col("fields")))


def unpack(objects: DataFrame, kind: str) -> DataFrame:
    """Rows (name, fields) of the objects of a kind; lists in the order of their entries' first field."""

    def value(f, t):
        entries = F.col("fields").getItem(f)
        if not t.startswith("array<"):
            return F.from_json(F.element_at(entries, 1), f"v {t}").getField("v").alias(f)
        return F.array_sort(F.transform(entries, lambda x: F.from_json(x, f"v {t[6:-1]}").getField("v"))).alias(f)

    return objects.where(F.col("kind") == kind).select("name", *(value(f, t) for f, t in KINDS[kind].items()))


def object_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (kind, name, hash, old_hash, delta) of the objects in both versions whose hashes differ: the entries that went and came, by field."""
    a = old.select("kind", "name", F.col("fields").alias("old_fields"), F.col("hash").alias("old_hash"))
    both = new.join(a, ["kind", "name"]).where("hash <> old_hash")
    was = lambda k: F.coalesce(F.try_element_at("old_fields", k), F.array().cast("array<string>"))
    each = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("key"), F.struct(
        F.array_except(was(e["key"]), e["value"]).alias("removed"), F.array_except(e["value"], was(e["key"])).alias("added")).alias("value")))
    changed = F.filter(each, lambda e: (F.size(e["value"]["removed"]) > 0) | (F.size(e["value"]["added"]) > 0))
    return both.select("kind", "name", "hash", "old_hash", F.map_from_entries(changed).alias("delta"))


def patched(fields: Column, delta: Column) -> Column:
    """Fields with a delta applied: each list less what went and with what came."""
    change = lambda k: F.try_element_at(delta, k)
    return F.transform_values(fields, lambda k, v: F.when(change(k).isNull(), v).otherwise(
        F.array_sort(F.concat(F.array_except(v, change(k).getField("removed")), change(k).getField("added")))))


def apply_deltas(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Objects of base, those with a delta in their next version."""
    d = deltas.select("kind", "name", "delta")
    both = base.drop("hash").join(d, ["kind", "name"], "left")
    both = both.withColumn("fields", F.when(F.col("delta").isNull(), F.col("fields")).otherwise(patched(F.col("fields"), F.col("delta")))).drop("delta")
    return both.withColumn("hash", object_hash(F.col("kind"), F.col("name"), F.col("fields")))


# from catalog rows -------------------------------------------------------------------------------------------------------------


def _listed(rows: DataFrame, by: str, entry: list[str], name: str) -> DataFrame:
    """One row for each value of `by` with its rows as structs; a catalog object has few."""
    return rows.groupBy(F.col(by).alias("name")).agg(F.collect_list(F.struct(*entry)).alias(name))


def _keyed(rows: DataFrame, group: list[str], lists: list[str]) -> DataFrame:
    """One row for each group, its columns `lists` in the order of ordinal, without nulls."""
    pick = lambda c: F.filter(F.transform("_all", lambda x: x.getField(c)), lambda v: v.isNotNull()).alias(c)
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("ordinal", *lists))).alias("_all")).select(*group, *map(pick, lists))


def check_body(definition: Column) -> Column:
    """What stands between the brackets of CHECK (...); null if the text is no check."""
    return F.nullif(F.regexp_extract(definition, r"(?s)CHECK \((.*)\)", 1), F.lit(""))


def table_objects(columns: DataFrame, constraints: DataFrame | None = None, foreign_keys: DataFrame | None = None, indexes: DataFrame | None = None) -> DataFrame:
    """Table objects of catalog rows.

    columns: (table_name, position, name, type, nullable, default_value). constraints: (table_name, name, type, ordinal, column_name,
    definition), generated not-null checks are left out. foreign_keys: (table_name, name, ordinal, column_name, referenced_table,
    referenced_column, update_action, delete_action). indexes: (table_name, name, method, ordinal, column_name, is_unique, predicate), those of
    a constraint's name are left out. Tables without columns are not there.
    """
    out = _listed(columns, "table_name", ["position", "name", "type", "nullable", "default_value"], "columns")
    if constraints is not None:
        real = constraints.where(~F.col("name").rlike("_not_null$"))
        real = _keyed(real, ["table_name", "name", "type", "definition"], ["column_name"]).withColumnRenamed("column_name", "columns")
        out = out.join(_listed(real, "table_name", ["name", "type", "columns", "definition"], "constraints"), "name", "left")
    if foreign_keys is not None:
        keys = _keyed(foreign_keys, ["table_name", "name", "referenced_table", "update_action", "delete_action"], ["column_name", "referenced_column"])
        keys = keys.withColumnsRenamed({"column_name": "columns", "referenced_column": "referenced_columns"})
        out = out.join(_listed(keys, "table_name", ["name", "columns", "referenced_table", "referenced_columns", "update_action", "delete_action"], "foreign_keys"), "name", "left")
    if indexes is not None:
        free = indexes if constraints is None else indexes.join(constraints.select("table_name", "name").distinct(), ["table_name", "name"], "left_anti")
        free = _keyed(free, ["table_name", "name", "method", "is_unique", "predicate"], ["column_name"]).withColumnRenamed("column_name", "columns")
        out = out.join(_listed(free, "table_name", ["name", "method", "columns", "is_unique", "predicate"], "indexes"), "name", "left")
    return pack(out, "table")


def dependency_edges(depends: DataFrame, routines: DataFrame) -> DataFrame:
    """Rows (name, needs) between routines, from edges (id, needs_id, kind) and routines (id, name): normal edges between known routines."""
    a = routines.select(F.col("id"), "name")
    b = routines.select(F.col("id").alias("needs_id"), F.col("name").alias("needs"))
    return depends.where("kind = 'n'").join(a, "id").join(b, "needs_id").select("name", "needs").distinct()


def routine_parts(text: Column) -> Column:
    """Struct (tag, body) of a routine's full definition: the dollar quote after AS, and what it encloses without leading white space."""
    pattern = r"(?s)^.*?AS (\$[^$]*\$)\s*(.*?)\1.*$"
    return F.struct(F.regexp_extract(text, pattern, 1).alias("tag"), F.regexp_extract(text, pattern, 2).alias("body"))


def routine_objects(routines: DataFrame, edges: DataFrame, triggers: DataFrame | None = None) -> DataFrame:
    """Function, procedure and trigger objects of rows (name, kind f or p, language, volatility, parameters, return_type, full_definition), edges
    (name, needs) and triggers (name, definition). Bodies of functions and triggers are normalised."""
    needs = edges.groupBy("name").agg(F.array_sort(F.collect_set("needs")).alias("dependencies"))
    rows = routines.join(needs, "name", "left").withColumn("parts", routine_parts(F.col("full_definition")))
    rows = rows.withColumn("tag", F.col("parts.tag")).withColumn("definition", F.when(F.col("kind") == "f", normalize_definition(F.col("parts.body"))).otherwise(F.col("parts.body")))
    out = pack(rows.where("kind = 'f'"), "function").unionByName(pack(rows.where("kind = 'p'"), "procedure"))
    if triggers is not None:
        named = triggers.select("name", normalize_definition(F.regexp_replace("definition", F.concat(F.lit(r"(?i)^CREATE TRIGGER\s+\Q"), "name", F.lit(r"\E\s+")), F.lit(""))).alias("definition"))
        out = out.unionByName(pack(named, "trigger"))
    return out


def objects_of(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Table objects of DataFrames: their columns, and a primary key for those with keys."""
    rows = [(name, k, f.name, f.dataType.simpleString(), f.nullable, None) for name, df in tables.items() for k, f in enumerate(df.schema.fields, 1)]
    columns = spark.createDataFrame(rows, "table_name string, position long, name string, type string, nullable boolean, default_value string")
    rows = [(name, f"{name}_pk", "PRIMARY KEY", k, c, None) for name, cs in (keys or {}).items() if cs and name in tables for k, c in enumerate(cs, 1)]
    constraints = spark.createDataFrame(rows, "table_name string, name string, type string, ordinal long, column_name string, definition string")
    return table_objects(columns, constraints)


def no_objects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OBJECT)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
