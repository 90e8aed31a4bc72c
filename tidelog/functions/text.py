"""Names, references, literals and statements as text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import TIME_FORMAT, utc

DIFF_PREFIX = "diffs/"
UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def split_name(name: Column, default: str = "public") -> Column:
    """Struct (schema, object): what stands before the first dot, or the default, and the rest."""
    dotted = F.instr(name, ".") > 0
    return F.struct(F.when(dotted, F.substring_index(name, ".", 1)).otherwise(F.lit(default)).alias("schema"),
                    F.when(dotted, F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name).alias("object"))


def quote_name(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def literal(c: Column, kind: T.DataType) -> Column:
    """A value as SQL text: NULL, number, or quoted text with doubled quotes; times with microseconds, in UTC if they have a zone, bytes in hex."""
    quoted = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        text = c.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.when(F.isnan(c) | (F.abs(c) == float("inf")), quoted(c.cast("string"))).otherwise(c.cast("string"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("'\\x"), F.lower(F.hex(c)), F.lit("'"))
    elif isinstance(kind, T.TimestampNTZType):
        text = quoted(F.date_format(c, TIME_FORMAT))
    elif isinstance(kind, T.TimestampType):
        text = quoted(F.concat(F.date_format(utc(c), TIME_FORMAT), F.lit("+00")))
    else:
        text = quoted(c.cast("string"))
    return F.when(c.isNull(), F.lit("NULL")).otherwise(text)


def normalize_definition(text: Column) -> Column:
    """Routine text on one line: white space runs become one blank, commas are followed by one, none stands
    inside brackets' edges or before a semicolon. Text with a line comment only loses its outer white space."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    for pattern, by in ((r"\s*,\s*", ", "), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s+;", ";")):
        flat = F.regexp_replace(flat, pattern, by)
    return F.when(F.instr(text, "--") > 0, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(flat)


def ref_parts(ref: Column) -> Column:
    """Struct (hash, is_diff) of a reference to a full object or to a difference."""
    return F.struct(F.regexp_replace(ref, "^" + DIFF_PREFIX, "").alias("hash"), ref.startswith(DIFF_PREFIX).alias("is_diff"))


def type_text(base: Column, length: Column, precision: Column, scale: Column) -> Column:
    """varchar(n), numeric(p,s) or the base name."""
    return F.when(length.isNotNull(), F.format_string("%s(%d)", base, length)).when(
        base.isin("numeric", "decimal") & precision.isNotNull(), F.format_string("%s(%d,%d)", base, precision, F.coalesce(scale, F.lit(0)))).otherwise(base)


def sequence_restart(last_value: Column, increment: Column, is_called: Column) -> Column:
    """Where a restored sequence goes on."""
    return F.when(is_called, last_value + increment).otherwise(last_value)


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID_PATTERN)


def create_table(name: str, columns: list[dict], constraints: list[dict] = ()) -> str:
    """CREATE TABLE text; columns: name, type, nullable, default; constraints: name, type, columns, definition."""
    q = lambda n: '"' + n.replace('"', '""') + '"'
    parts = [f"{q(c['name'])} {c['type']}" + ("" if c.get("nullable", True) else " NOT NULL") + (f" DEFAULT {c['default']}" if c.get("default") is not None else "") for c in columns]
    for c in constraints:
        body = f"CHECK ({c['definition']})" if c["type"] == "CHECK" else f"{c['type']} ({', '.join(map(q, c['columns']))})"
        parts.append(f"CONSTRAINT {q(c['name'])} {body}")
    return f"CREATE TABLE {'.'.join(map(q, name.split('.', 1)))} (" + ", ".join(parts) + ")"


def create_index(table: str, index: dict) -> str:
    """CREATE INDEX text with uniqueness, method and predicate."""
    q = lambda n: '"' + n.replace('"', '""') + '"'
    where = f" WHERE {index['predicate']}" if index.get("predicate") else ""
    return f"CREATE {'UNIQUE ' if index.get('unique') else ''}INDEX {q(index['name'])} ON {'.'.join(map(q, table.split('.', 1)))} USING {index.get('method', 'btree')} ({', '.join(map(q, index['columns']))}){where}"


def add_foreign_key(table: str, fk: dict) -> str:
    q = lambda n: '"' + n.replace('"', '""') + '"'
    names = lambda cs: ", ".join(map(q, cs))
    return (f"ALTER TABLE {'.'.join(map(q, table.split('.', 1)))} ADD CONSTRAINT {q(fk['name'])} FOREIGN KEY ({names(fk['columns'])}) REFERENCES "
            f"{'.'.join(map(q, fk['referenced_table'].split('.', 1)))} ({names(fk['referenced_columns'])}) ON UPDATE {fk.get('update_action', 'NO ACTION')} ON DELETE {fk.get('delete_action', 'NO ACTION')}")


def parse_integer(text: Column) -> Column:
    """An integer of up to 38 digits; null if the text is none."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("decimal(38,0)"))


def driver_value(value: Column, kind: Column) -> Column:
    """Struct (bytes, number, text) of what a driver hands over as bytes, by the column's declared type: bytea stays bytes, inexact and
    decimal types are numbers, all others text. Two fields are null."""
    base = F.regexp_replace(F.lower(kind), r"\s*\([^)]*\)", "")
    number, as_text = base.isin("numeric", "decimal", "real", "double precision", "float"), F.decode(value, "UTF-8")
    return F.struct(F.when(base == "bytea", value).alias("bytes"), F.when(number, as_text.try_cast("double")).alias("number"), F.when(~number & (base != "bytea"), as_text).alias("text"))
