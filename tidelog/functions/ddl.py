"""Statements that make catalog objects and insert rows, as text expressions over typed objects and rows.

The standard dialect leaves out what only PostgreSQL has: IF NOT EXISTS of schemas, index methods and predicates, restarts of sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import literal, quote_name, sequence_restart, split_name

#: Steps of a restore: what a statement makes, and the phase it belongs to.
STEPS = {"schema": 1, "sequence": 1, "restart": 1, "table": 2, "rows": 3, "foreign key": 4, "index": 4, "routine": 5}


def qualified(name: Column) -> Column:
    """A name with its schema, both quoted."""
    parts = split_name(name)
    return F.concat(quote_name(parts.getField("schema")), F.lit("."), quote_name(parts.getField("object")))


def _names(columns: Column) -> Column:
    return F.array_join(F.transform(columns, quote_name), ", ")


def _optional(condition: Column, *text: Column) -> Column:
    return F.when(condition, F.concat(*text)).otherwise(F.lit(""))


def _step(df: DataFrame, step: str, statement: Column, number: Column | None = None) -> DataFrame:
    return df.select(F.lit(STEPS[step]).alias("phase"), F.lit(step).alias("step"), (F.lit(0) if number is None else number).cast("int").alias("number"), "name", statement.alias("statement"))


def schema_statements(named: DataFrame, postgres: bool = True) -> DataFrame:
    """CREATE SCHEMA of all schemas of objects (name)."""
    schemas = named.select(split_name(F.col("name")).getField("schema").alias("name")).distinct()
    return _step(schemas, "schema", F.concat(F.lit("CREATE SCHEMA " + ("IF NOT EXISTS " if postgres else "")), quote_name(F.col("name"))))


def sequence_statements(sequences: DataFrame, postgres: bool = True) -> DataFrame:
    """CREATE SEQUENCE, and where it goes on."""
    restart = sequence_restart(F.col("last_value"), F.col("increment"), F.col("is_called"))
    text = lambda c: F.col(c).cast("string")
    bound = lambda c, word: F.coalesce(F.concat(F.lit(f" {word} "), text(c)), F.lit(f" NO {word}"))
    start = text("start") if postgres else restart.cast("string")
    made = F.concat(F.lit("CREATE SEQUENCE "), qualified(F.col("name")), F.lit(" AS "), "type", F.lit(" START WITH "), start, F.lit(" INCREMENT BY "), text("increment"),
                    bound("min", "MINVALUE"), bound("max", "MAXVALUE"), F.when(F.col("cycle"), " CYCLE").otherwise(" NO CYCLE"))
    out = _step(sequences, "sequence", made)
    if postgres:
        out = out.unionByName(_step(sequences, "restart", F.concat(F.lit("ALTER SEQUENCE "), qualified(F.col("name")), F.lit(" RESTART WITH "), restart.cast("string")), F.lit(1)))
    return out


def table_statements(tables: DataFrame) -> DataFrame:
    """CREATE TABLE with columns, defaults, and constraints but foreign keys."""
    column = lambda c: F.concat(quote_name(c["name"]), F.lit(" "), c["type"], _optional(c["default_value"].isNotNull(), F.lit(" DEFAULT "), c["default_value"]),
                                _optional(~c["nullable"], F.lit(" NOT NULL")))
    body = lambda c: F.when(c["type"] == "CHECK", F.concat(F.lit("CHECK ("), c["definition"], F.lit(")"))).otherwise(F.concat(c["type"], F.lit(" ("), _names(c["columns"]), F.lit(")")))
    rule = lambda c: F.concat(F.lit("CONSTRAINT "), quote_name(c["name"]), F.lit(" "), body(c))
    parts = F.concat(F.transform("columns", column), F.transform("constraints", rule))
    return _step(tables, "table", F.concat(F.lit("CREATE TABLE "), qualified(F.col("name")), F.lit(" ("), F.array_join(parts, ", "), F.lit(")")))


def rule_statements(tables: DataFrame, postgres: bool = True) -> DataFrame:
    """Foreign keys, and indexes that back no constraint."""
    k = tables.select("name", F.explode("foreign_keys").alias("k"))
    key = F.concat(F.lit("ALTER TABLE "), qualified(F.col("name")), F.lit(" ADD CONSTRAINT "), quote_name(F.col("k.name")), F.lit(" FOREIGN KEY ("), _names(F.col("k.columns")),
                   F.lit(") REFERENCES "), qualified(F.col("k.referenced_table")), F.lit(" ("), _names(F.col("k.referenced_columns")),
                   F.lit(") ON UPDATE "), F.coalesce("k.update_action", F.lit("NO ACTION")), F.lit(" ON DELETE "), F.coalesce("k.delete_action", F.lit("NO ACTION")))
    i = tables.select("name", F.explode("indexes").alias("i"))
    index = F.concat(F.lit("CREATE "), F.when(F.col("i.is_unique"), "UNIQUE ").otherwise(""), F.lit("INDEX "), quote_name(F.col("i.name")), F.lit(" ON "), qualified(F.col("name")),
                     *([F.lit(" USING "), F.coalesce("i.method", F.lit("btree"))] if postgres else []), F.lit(" ("), _names(F.col("i.columns")), F.lit(")"),
                     *([_optional(F.col("i.predicate").isNotNull(), F.lit(" WHERE "), F.col("i.predicate"))] if postgres else []))
    return _step(k, "foreign key", key).unionByName(_step(i, "index", index, F.lit(1)))


def routine_statement(kind: str) -> Column:
    """CREATE FUNCTION, PROCEDURE or TRIGGER of a typed object; names of routines stand as the catalog gives them."""
    body = F.concat_ws(" ", F.concat(F.lit("LANGUAGE "), "language"), F.lit("AS"), "tag", "definition", "tag")
    if kind == "function":
        return F.concat(F.lit("CREATE FUNCTION "), "name", F.lit("("), F.coalesce("parameters", F.lit("")), F.lit(") RETURNS "), "return_type", F.lit(" "), body,
                        _optional(F.coalesce("volatility", F.lit("")) != "", F.lit(" "), F.col("volatility")))
    if kind == "procedure":
        return F.concat(F.lit("CREATE PROCEDURE "), "name", F.lit("("), F.coalesce("parameters", F.lit("")), F.lit(") "), body)
    return F.concat(F.lit("CREATE TRIGGER "), "name", F.lit(" "), "definition")


def insert_statements(rows: DataFrame, table: str, columns: list[T.StructField], at: list[str], order: list[str]) -> DataFrame:
    """Rows (at, statement): one INSERT for each group `at` of placed rows, its rows in the order of `order`. A group is a chunk, so its size is bounded."""
    values = F.concat(F.lit("("), F.concat_ws(", ", *(literal(F.col(f"`{f.name}`"), f.dataType) for f in columns)), F.lit(")"))
    head = F.concat(F.lit("INSERT INTO "), qualified(F.lit(table)), F.lit(" ("), F.concat_ws(", ", *(quote_name(F.lit(f.name)) for f in columns)), F.lit(") VALUES "))
    each = rows.select(*at, *order, values.alias("_values"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, "_values"))), lambda x: x.getField("_values"))
    return each.groupBy(*at).agg(ordered.alias("_all")).select(*at, F.concat(head, F.array_join("_all", ", ")).alias("statement"))
