"""Where tables and objects come from, and where a restore makes them: a folder of Parquet tables, a JDBC database; the session's catalog as a source."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators.objects import comparable_key
from . import pg, store


class Source(Protocol):
    engine: str

    def names(self) -> list[str]: ...

    def table(self, name: str) -> DataFrame: ...

    def objects(self) -> DataFrame | None: ...

    def keys(self) -> dict[str, list[str]]: ...


class ParquetSource:
    """Tables NAME.parquet of a folder."""

    engine = "parquet"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def names(self) -> list[str]:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = (s.getPath().getName() for s in fs.listStatus(jvm_path))
        return sorted(n.removesuffix(".parquet") for n in found if n.endswith(".parquet"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def objects(self) -> None:
        """Nothing but what the tables' own columns and keys say."""

    def keys(self) -> dict[str, list[str]]:
        return {}


class JdbcSource:
    """Base tables and catalog objects of a database by JDBC; needs its driver on the class path. With a numeric column and bounds a table is read in parts."""

    engine = "jdbc"
    SYSTEM = ("pg_catalog", "information_schema", "pg_toast", "sys", "sysibm", "syscat", "sysfun", "sysproc", "sysstat", "syscs_diag", "syscs_util", "nullid", "sqlj")

    def __init__(self, spark: SparkSession, url: str, properties: dict | None = None, split: dict[str, dict] | None = None):
        self.spark, self.url, self.properties, self.split = spark, url, properties or {}, split or {}
        self.postgres = url.startswith("jdbc:postgresql:")

    def _metadata(self, call: str, *args) -> list[dict]:
        """Rows that a method of the driver's metadata gives, by lower-case column name; a catalog has few."""
        with connection(self.spark, self.url, self.properties) as c:
            found = getattr(c.getMetaData(), call)(*args)
            about = found.getMetaData()
            names = [about.getColumnLabel(k).lower() for k in range(1, about.getColumnCount() + 1)]
            rows = []
            while found.next():
                rows.append({n: found.getString(k) for k, n in enumerate(names, 1)})
            return rows

    def _tables(self) -> list[tuple[str, str]]:
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        found = [(r["table_schem"], r["table_name"]) for r in self._metadata("getTables", None, None, "%", kinds)]
        return sorted(t for t in found if (t[0] or "").lower() not in self.SYSTEM)

    def names(self) -> list[str]:
        return [f"{s}.{t}" for s, t in self._tables()]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, ".".join(_quoted(p) for p in name.split(".", 1)), properties=self.properties, **self.split.get(name, {}))

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, f"({sql}) AS t", properties=self.properties)

    def keys(self) -> dict[str, list[str]]:
        """Primary keys that pages can follow, by table."""
        found = catalog.unpack(self.tables_of(), "table")
        rows = found.select("name", "columns", F.explode("constraints").alias("c")).where("c.type = 'PRIMARY KEY'").collect()
        return {r.name: list(r.c["columns"]) for r in rows if comparable_key({c["name"]: c["type"] for c in r["columns"]}, r.c["columns"])}

    def tables_of(self) -> DataFrame:
        """Table objects: columns, keys, foreign keys and indexes by the driver's metadata, checks where the engine is PostgreSQL."""
        rules = {"0": "CASCADE", "1": "RESTRICT", "2": "SET NULL", "3": "NO ACTION", "4": "SET DEFAULT"}
        columns, constraints, foreign, indexes = [], [], [], []
        for schema, table in self._tables():
            name = f"{schema}.{table}"
            for r in self._metadata("getColumns", None, schema, table, "%"):
                columns.append((name, int(r["ordinal_position"]), r["column_name"], _type_name(r), r["nullable"] != "0", r["column_def"]))
            for r in self._metadata("getPrimaryKeys", None, schema, table):
                constraints.append((name, r["pk_name"], "PRIMARY KEY", int(r["key_seq"]), r["column_name"], None))
            for r in self._metadata("getImportedKeys", None, schema, table):
                foreign.append((name, r["fk_name"], int(r["key_seq"]), r["fkcolumn_name"], f"{r['pktable_schem']}.{r['pktable_name']}", r["pkcolumn_name"], rules.get(r["update_rule"]), rules.get(r["delete_rule"])))
            for r in self._metadata("getIndexInfo", None, schema, table, False, True):
                if r["index_name"] and r["column_name"]:
                    indexes.append((name, r["index_name"], "btree", int(r["ordinal_position"]), r["column_name"], r["non_unique"] in ("0", "false", "f"), r["filter_condition"]))
        make = self.spark.createDataFrame
        columns = make(columns, "table_name string, position long, name string, type string, nullable boolean, default_value string")
        constraints = make(constraints, "table_name string, name string, type string, ordinal long, column_name string, definition string")
        foreign = make(foreign, "table_name string, name string, ordinal long, column_name string, referenced_table string, referenced_column string, update_action string, delete_action string")
        indexes = make(indexes, "table_name string, name string, method string, ordinal long, column_name string, is_unique boolean, predicate string")
        if self.postgres:
            more = self.query(pg.CONSTRAINTS)
            constraints = constraints.unionByName(more.select("table_name", "name", "type", F.col("ordinal").cast("long").alias("ordinal"), "column_name", catalog.check_body(F.col("definition")).alias("definition")))
        else:
            # the index of a key has a name of its own; it is the one over the same columns
            of = lambda d: d.groupBy("table_name", "name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))).alias("cs"))
            backing = of(constraints.select("table_name", "name", "ordinal", "column_name").union(foreign.select("table_name", "name", "ordinal", "column_name"))).select("table_name", "cs").distinct()
            backed = of(indexes).join(backing, ["table_name", "cs"], "left_semi").select("table_name", "name")
            indexes = indexes.join(backed, ["table_name", "name"], "left_anti")
        return catalog.table_objects(columns, constraints, foreign, indexes)

    def objects(self) -> DataFrame:
        """All catalog objects; sequences and routines are read where the engine is PostgreSQL, sequences from Derby too."""
        found = [self.tables_of()]
        if self.postgres:
            listed = self.query(pg.SEQUENCES)
            states = [self.query(f"SELECT '{r.name}' AS name, last_value, is_called FROM {'.'.join(_quoted(p) for p in r.name.split('.', 1))}") for r in listed.select("name").collect()]
            if states:
                found.append(catalog.pack(listed.join(reduce(DataFrame.unionByName, states), "name"), "sequence"))
            routines = self.query(pg.ROUTINES)
            edges = catalog.dependency_edges(self.query(pg.DEPENDS), routines.select("id", "name"))
            found.append(catalog.routine_objects(routines, edges, self.query(pg.TRIGGERS)))
        elif self.url.startswith("jdbc:derby:"):
            # the next value to be given, as a sequence of this engine has no last one
            found.append(catalog.pack(self.query(
                "SELECT TRIM(s.SCHEMANAME) || '.' || q.SEQUENCENAME AS \"name\", 'BIGINT' AS \"type\", STARTVALUE AS \"start\", MINIMUMVALUE AS \"min\", MAXIMUMVALUE AS \"max\", "
                "q.INCREMENT AS \"increment\", CYCLEOPTION = 'Y' AS \"cycle\", COALESCE(SYSCS_UTIL.SYSCS_PEEK_AT_SEQUENCE(TRIM(s.SCHEMANAME), q.SEQUENCENAME), MAXIMUMVALUE) AS \"last_value\", "
                "FALSE AS \"is_called\" FROM SYS.SYSSEQUENCES q JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = q.SCHEMAID WHERE s.SCHEMANAME NOT LIKE 'SYS%'"), "sequence"))
        return catalog.union(found)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type_name(r: dict) -> str:
    """A column's type with length, or precision and scale."""
    name = r["type_name"]
    if any(k in name.lower() for k in ("char", "binary")) and "(" not in name and r["column_size"] and int(r["column_size"]) < 1 << 30:
        return f"{name}({r['column_size']})"
    if name.lower() in ("numeric", "decimal") and r["column_size"]:
        return f"{name}({r['column_size']},{r['decimal_digits'] or 0})"
    return name


@contextmanager
def connection(spark: SparkSession, url: str, properties: dict | None = None):
    """A connection of the driver's JVM, closed at the end; what is not committed is undone."""
    jvm, info = spark._jvm, spark._jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        if k == "driver":
            jvm.java.lang.Class.forName(v)
        info.setProperty(k, str(v))
    c = jvm.java.sql.DriverManager.getConnection(url, info)
    c.setAutoCommit(False)
    try:
        yield c
        c.commit()
    except BaseException:
        c.rollback()
        raise
    finally:
        c.close()


class CatalogSource:
    """Tables of a database of the session's catalog; views are left out."""

    engine = "catalog"

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if t.tableType in ("MANAGED", "EXTERNAL"))

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def objects(self) -> None:
        """Nothing but what the tables' own columns and keys say."""

    def keys(self) -> dict[str, list[str]]:
        return {}


SOURCES = {"parquet": ParquetSource, "jdbc": JdbcSource, "catalog": CatalogSource}


def open_source(spark: SparkSession, url: str) -> Source:
    """By scheme: jdbc:..., catalog:DATABASE, else a folder of Parquet tables."""
    if url.startswith("jdbc:"):
        return JdbcSource(spark, url)
    if url.startswith("catalog:"):
        return CatalogSource(spark, url.removeprefix("catalog:") or "default")
    return ParquetSource(spark, url)


def is_empty(source: Source) -> bool:
    """Whether a source has no table with a row."""
    return all(source.table(n).isEmpty() for n in source.names())


class FolderTarget:
    """A restore into a folder that does not exist: tables NAME.parquet and the statements of the other objects. It is made beside and renamed last."""

    engine, postgres = "parquet", True

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.staging = spark, path.rstrip("/"), None

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def is_empty(self) -> bool:
        fs, p = self._fs(self.path)
        return not fs.exists(p)

    def begin(self) -> None:
        if self.staging:
            raise store.TransactionInProgress("a restore is open")
        self.staging = f"{self.path}.{uuid.uuid4().hex}.part"

    def _at(self) -> str:
        if not self.staging:
            raise store.NoTransaction("no restore is open")
        return self.staging

    def run(self, statements: DataFrame) -> None:
        statements.coalesce(1).write.mode("append").parquet(f"{self._at()}/statements")

    def rows(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self._at()}/{name}.parquet")

    def commit(self) -> None:
        fs, staged = self._fs(self._at())
        _, final = self._fs(self.path)
        if fs.exists(final) or not fs.rename(staged, final):
            raise store.StoreError(f"could not publish {self.path}")
        self.staging = None

    def rollback(self) -> None:
        fs, staged = self._fs(self._at())
        fs.delete(staged, True)
        self.staging = None


class JdbcTarget:
    """A restore into an empty database. Statements run in the driver's connection; rows are written by the executors, each part in a
    transaction of its own, so what an unfinished restore has made is dropped on rollback."""

    engine = "jdbc"

    def __init__(self, spark: SparkSession, url: str, properties: dict | None = None):
        self.spark, self.url, self.properties = spark, url, properties or {}
        self.postgres = url.startswith("jdbc:postgresql:")
        self.undo: list[str] | None = None

    def is_empty(self) -> bool:
        return is_empty(JdbcSource(self.spark, self.url, self.properties))

    def begin(self) -> None:
        if self.undo is not None:
            raise store.TransactionInProgress("a restore is open")
        self.undo = []

    def _open(self) -> list[str]:
        if self.undo is None:
            raise store.NoTransaction("no restore is open")
        return self.undo

    def run(self, statements: DataFrame) -> None:
        undo = self._open()
        with connection(self.spark, self.url, self.properties) as c:
            there = {r["table_schem"] for r in JdbcSource(self.spark, self.url, self.properties)._metadata("getSchemas")}
            for r in statements.orderBy("phase", F.expr("array_position(array('schema', 'sequence', 'restart', 'table', 'foreign key', 'index', 'routine'), step)"), "number", "name").toLocalIterator():
                if r.step == "schema" and r.name in there:
                    continue
                c.createStatement().execute(r.statement)
                drop = {"table": "DROP TABLE ", "sequence": "DROP SEQUENCE "}.get(r.step)
                if drop:
                    undo.append(drop + ".".join(_quoted(p) for p in r.name.split(".", 1)) + (" RESTRICT" if r.step == "sequence" else ""))

    def rows(self, name: str, df: DataFrame) -> None:
        self._open()
        df.write.mode("append").jdbc(self.url, ".".join(_quoted(p) for p in name.split(".", 1)), properties=self.properties)

    def commit(self) -> None:
        self._open()
        self.undo = None

    def rollback(self) -> None:
        undo, self.undo = self._open(), None
        for statement in reversed(undo):
            with connection(self.spark, self.url, self.properties) as c:
                c.createStatement().execute(statement)


def open_target(spark: SparkSession, url: str) -> FolderTarget | JdbcTarget:
    """By scheme: jdbc:..., else a folder."""
    return JdbcTarget(spark, url) if url.startswith("jdbc:") else FolderTarget(spark, url)
