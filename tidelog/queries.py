"""Queries of the version-store operators over the test tables, each with DuckDB SQL for the same rows.

Versions of a table with an integer key k: v1 lacks k % 10 = 9; v2 lacks k % 10 = 0 and has a measure changed where k % 10 = 3; v3 is v2 with the
measure changed where k % 10 = 5 and without k % 10 = 7. vp2, for differences by place, is v1 with the measure changed where
k % 10 = 3 and without the last keys.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical, ddl, text
from .operators import catalog, diff, objects, paging, validate
from .plans import manifest
from .plans.shared import shared_dir
from .sources.store import Store

CHUNK, BATCH = 500, 2000
VP_SHARE = 0.95

#: Columns of the tables that queries hash: name to type letter of the canonical form.
COLUMNS = {
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "f", "o_orderdate": "t", "o_orderpriority": "s"},
    "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "f", "c_mktsegment": "s"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "f"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "f", "l_extendedprice": "f", "l_discount": "f", "l_tax": "f",
                 "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"},
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _version(df: DataFrame, k: int, key: str, measure: str) -> DataFrame:
    m = F.col(key) % 10
    if k == 1:
        return df.where(m != 9)
    hit = m.isin(3, 5) if k == 3 else m == 3
    out = df.where(~m.isin(0, 7) if k == 3 else m != 0)
    return out.withColumn(measure, F.when(hit, F.col(measure) + 1).otherwise(F.col(measure)))


def orders_v(spark, sf_dir, k):
    return _version(load(spark, sf_dir, "orders"), k, "o_orderkey", "o_totalprice")


def orders_vp2(spark, sf_dir):
    df = orders_v(spark, sf_dir, 1)
    last = df.agg(F.floor(F.max("o_orderkey") * VP_SHARE)).scalar()
    df = df.where(F.col("o_orderkey") <= last)
    return df.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


def _placed(df: DataFrame) -> DataFrame:
    return manifest.placed(df, ["o_orderkey"], CHUNK, BATCH)


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple], names: str) -> str:
    show = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(show(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


# inputs that no table has --------------------------------------------------------------------------------------------------

OLD_OBJECTS = [("table", "public.a", "h1"), ("table", "public.b", "diffs/h2"), ("sequence", "public.s", "h3"), ("routine", "f", "h4")]
NEW_OBJECTS = [("table", "public.a", "h1"), ("table", "public.b", "h5"), ("sequence", "public.s", "diffs/h3"), ("table", "public.c", "h6")]
COLS_V1 = [("id", "bigint", False, None, 1), ("name", "varchar(16)", True, None, 2), ("price", "numeric(10,2)", True, "0", 3)]
COLS_V2 = [("id", "bigint", False, None, 1), ("name", "varchar(32)", True, None, 2), ("note", "text", True, "''", 4)]
CONSTRAINTS = [("t", "t_pk", "PRIMARY KEY", 2, "b", None), ("t", "t_pk", "PRIMARY KEY", 1, "z", None), ("t", "t_ck", "CHECK", None, None, "b > 0"),
               ("t", "t_b_not_null", "CHECK", None, None, "b IS NOT NULL"), ("u", "u_uk", "UNIQUE", 1, "c", None), ("u", "u_pk", "PRIMARY KEY", 1, "j", None)]
FKS = [("t", "t_fk", 2, "b", "u", "y"), ("t", "t_fk", 1, "a", "u", "x"), ("v", "v_fk", 1, "k", "t", "z")]
TYPES = [("t", "z", "varchar(16)"), ("t", "b", "numeric(4,2)"), ("u", "j", "json"), ("u", "c", "integer")]
EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("e", "d"), ("f", "e"), ("f", "a")]
NAMES = [("public.users",), ("users",), ("sales.orders.old",), ("",)]
SEQ_V1 = [("s1", 1, 1, 100, False), ("s2", -5, -5, 10, True), ("s3", 7, 1, None, False)]
SEQ_V2 = [("s1", 1, 1, 200, True), ("s2", -5, -5, 10, True), ("s3", 9, 1, 5, False)]
ROUTINES = [("create  function f( a int ,b int )\n returns int ;",), ("select 1 -- keep\n  this  ",), ("  x(\t1 )  ;",)]
INDEXES = [("t", "t_pk", "btree", True, None, ["z", "b"]), ("t", "t_ix", "btree", False, "b > 1", ["b", "a"]), ("u", "u_ix", "hash", False, None, ["c"])]
PROCS = [(1, "public.f", "f", "sql", "IMMUTABLE", "a integer", "integer", "CREATE OR REPLACE FUNCTION public.f(a integer) RETURNS integer LANGUAGE sql AS $function$ SELECT  a ,\n public.g( a ) $function$"),
         (2, "public.g", "f", "plpgsql", None, None, "void", "CREATE OR REPLACE FUNCTION public.g() RETURNS void LANGUAGE plpgsql AS $body$\nBEGIN SELECT 1 ; END$body$\n"),
         (3, "sales.p", "p", "sql", None, "", None, "CREATE OR REPLACE PROCEDURE sales.p() LANGUAGE sql AS $$ DELETE FROM t $$")]
DEPENDS = [(1, 2, "n"), (3, 1, "n"), (3, 2, "a"), (1, 99, "n"), (1, 2, "n")]
TRIGGERS = [("trg", "CREATE TRIGGER trg BEFORE INSERT ON t  FOR EACH ROW EXECUTE FUNCTION f( )")]
CHECKS = [("CHECK ((b > 0))",), ("CHECK (a = ANY (ARRAY[1, 2])) NOT VALID",), ("UNIQUE (a)",), (None,)]
INTEGERS = [("12",), (" -7 ",), ("99999999999999999999999999999999999999",), ("1.5",), ("",), ("x",), (None,)]
KINDS = [("routine", "f"), ("index", "i"), ("rows", "t"), ("sequence", "s"), ("table", "t"), ("foreign key", "k")]


def q_table_stats(spark, d):
    return manifest.table_stats(load(spark, d, "orders"))


def q_batch_plan(spark, d):
    stats = _values(spark, [(n, n) for n in (0, 1, 100, 210, 300_000, 5 << 20, 1 << 31)], "n_rows long, max_row_size long")
    return manifest.batch_plan(stats)


def q_row_hash(spark, d):
    return canonical.with_hash(load(spark, d, "customer")).select("c_custkey", "row_hash")


def q_row_hash_part(spark, d):
    return canonical.with_hash(load(spark, d, "part")).select("p_partkey", "row_hash")


def q_chunk_manifest(spark, d):
    return manifest.chunk_manifest(_placed(load(spark, d, "orders")))


def q_batch_manifest(spark, d):
    return manifest.batch_manifest(q_chunk_manifest(spark, d))


def q_keyless_manifest(spark, d):
    return manifest.chunk_manifest(manifest.placed(load(spark, d, "lineitem"), None, CHUNK, BATCH))


def q_keyset_first(spark, d):
    return paging.keyset_page(load(spark, d, "orders"), ["o_orderkey"], 20).select("o_orderkey", "o_custkey")


def q_keyset_page_single(spark, d):
    return paging.keyset_page(load(spark, d, "orders"), ["o_orderkey"], 50, (100,)).select("o_orderkey", "o_custkey")


def q_keyset_page_composite(spark, d):
    return paging.keyset_page(load(spark, d, "conversations"), ["conv_id", "turn"], 40, (3, 1)).select("conv_id", "turn", "role")


def q_offset_page(spark, d):
    return paging.offset_page(load(spark, d, "lineitem"), 30, 100).select("l_orderkey", "l_linenumber", "l_partkey")


def q_diff_keyed(spark, d):
    return diff.diff_keyed(orders_v(spark, d, 1), orders_v(spark, d, 2), ["o_orderkey"])


def q_diff_keyed_customer(spark, d):
    df = load(spark, d, "customer")
    return diff.diff_keyed(_version(df, 1, "c_custkey", "c_acctbal"), _version(df, 2, "c_custkey", "c_acctbal"), ["c_custkey"]).select("c_custkey", "op")


def q_diff_positional(spark, d):
    return diff.diff_positional(_placed(orders_v(spark, d, 1)), _placed(orders_vp2(spark, d)))


def q_diff_keyless(spark, d):
    df = load(spark, d, "lineitem")
    old, new = df.where("l_orderkey % 10 <> 9"), df.where("l_orderkey % 10 <> 0").unionAll(df.where("l_orderkey % 10 = 1"))
    return diff.diff_keyless(old, new)


def q_diff_summary(spark, d):
    return q_diff_positional(spark, d).groupBy("batch_no", "chunk_no", "op").agg(F.count("*").alias("n"))


def q_changed_chunks(spark, d):
    old, new = (manifest.chunk_manifest(_placed(x)) for x in (orders_v(spark, d, 1), orders_vp2(spark, d)))
    return diff.changed_parts(old, new, ["batch_no", "chunk_no"], "chunk_hash").select("batch_no", "chunk_no", "op")


def q_changed_batches(spark, d):
    old, new = (manifest.batch_manifest(manifest.chunk_manifest(_placed(x))) for x in (orders_v(spark, d, 1), orders_vp2(spark, d)))
    return diff.changed_parts(old, new, ["batch_no"], "batch_hash").select("batch_no", "op")


def q_pruned_diff(spark, d):
    old, new = _placed(orders_v(spark, d, 1)), _placed(orders_vp2(spark, d))
    touched = diff.changed_parts(manifest.chunk_manifest(old), manifest.chunk_manifest(new), ["batch_no", "chunk_no"], "chunk_hash")
    return diff.pruned_diff(old, new, touched)


def q_apply_diff(spark, d):
    v1, v2 = orders_v(spark, d, 1), orders_v(spark, d, 2)
    return diff.apply_changes(v1, diff.changes(v1, v2, ["o_orderkey"]), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def q_diff_chain(spark, d):
    v1, v2, v3 = (orders_v(spark, d, k) for k in (1, 2, 3))
    key = ["o_orderkey"]
    return diff.apply_changes(v1, diff.fold_chain([diff.changes(v1, v2, key), diff.changes(v2, v3, key)], key), key).select("o_orderkey", "o_totalprice")


def q_missing_targets(spark, d):
    v1, v2 = orders_v(spark, d, 1), orders_v(spark, d, 2)
    return diff.missing_targets(v2, diff.changes(v1, v2, ["o_orderkey"]), ["o_orderkey"])


def _parts(spark, d, old, new, op):
    """Chunks of two placed versions that only one has."""
    return diff.changed_parts(manifest.chunk_manifest(old), manifest.chunk_manifest(new), ["batch_no", "chunk_no"], "chunk_hash").where(F.col("op") == op)


def q_tombstone_chunk(spark, d):
    old, new = _placed(orders_v(spark, d, 1)), _placed(orders_vp2(spark, d))
    return diff.tombstones(old.join(_parts(spark, d, old, new, "D"), ["batch_no", "chunk_no"], "left_semi"))


def q_new_chunk(spark, d):
    old, new = _placed(orders_vp2(spark, d)), _placed(orders_v(spark, d, 1))
    return diff.fresh(new.join(_parts(spark, d, old, new, "I"), ["batch_no", "chunk_no"], "left_semi"))


def q_apply_positional(spark, d):
    old, new = _placed(orders_v(spark, d, 1)), _placed(orders_vp2(spark, d))
    return diff.apply_positional(old, diff.diff_positional(old, new), new).select("batch_no", "chunk_no", "pos", "o_orderkey", "row_hash")


def q_stale_places(spark, d):
    old, new = _placed(orders_v(spark, d, 1)), _placed(orders_vp2(spark, d))
    return diff.stale_places(new, diff.diff_positional(old, new))


def q_page_cursor(spark, d):
    return paging.next_cursor(paging.keyset_page(load(spark, d, "conversations"), ["conv_id", "turn"], 40, (3, 1)), ["conv_id", "turn"])


# through a store -----------------------------------------------------------------------------------------------------------

_STORES: dict = {}


def _store(spark, d) -> tuple[Store, list[str]]:
    """A store with three snapshots of orders, customer and lineitem, made once for a session and folder; their ids."""
    key = spark.sparkContext.applicationId, d
    if key not in _STORES:
        store = Store(spark, f"{shared_dir(spark)}/tidelog-store-{uuid.uuid4().hex}")
        keys, sizes = {"orders": ["o_orderkey"], "customer": ["c_custkey"]}, {"orders": (BATCH, CHUNK), "customer": (500, 100), "lineitem": (20_000, 1000)}
        customer, lines = load(spark, d, "customer"), load(spark, d, "lineitem")
        ids = [store.create({"orders": orders_v(spark, d, 1), "customer": customer, "lineitem": lines}, keys, "s1", sizes)]
        ids.append(store.snapshot({"orders": orders_v(spark, d, 2)}, message="s2", keep_others=True))
        ids.append(store.snapshot({"orders": orders_v(spark, d, 3), "customer": customer.withColumn("c_note", F.col("c_name"))}, message="s3"))
        _STORES[key] = store, ids
    return _STORES[key]


def q_snapshot_log(spark, d):
    return _store(spark, d)[0].log().select("seq", "message", "engine", "version")


def _travel(spark, d, at, as_of=False):
    store, ids = _store(spark, d)
    entry = store.find(at(store, ids), as_of)
    rows = store.table("orders", entry["snapshot_id"])
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(entry["message"]).alias("snapshot_id"), "n", "total")


def q_time_travel_id(spark, d):
    return _travel(spark, d, lambda store, ids: ids[1])


def q_time_travel_exact_ts(spark, d):
    return _travel(spark, d, lambda store, ids: store.find(ids[0])["ts"])


def q_time_travel_latest(spark, d):
    return _travel(spark, d, lambda store, ids: None)


def q_time_travel_as_of(spark, d):
    between = lambda store, ids: datetime.fromisoformat(store.find(ids[2])["ts"]) - timedelta(microseconds=1)
    return _travel(spark, d, between, as_of=True)


def q_store_restore(spark, d):
    store, ids = _store(spark, d)
    return store.restore(ids[1])["orders"]


def q_store_restore_keyless(spark, d):
    store, ids = _store(spark, d)
    return store.restore(ids[1])["lineitem"]


def q_store_diff(spark, d):
    store, ids = _store(spark, d)
    return store.diff("orders", ids[0], ids[1])


def q_store_changed_batches(spark, d):
    store, ids = _store(spark, d)
    return store.changed_batches("orders", ids[1], ids[2]).select("batch_no", "op", "new_hash")


def q_store_manifest(spark, d):
    store, ids = _store(spark, d)
    return catalog.union([store.manifest(i).where("table_name = 'orders'").select(F.lit(f"s{k}").alias("snapshot_id"), "batch_no", "n_chunks", "n_rows", "batch_hash") for k, i in enumerate(ids, 1)])


def q_store_dedup(spark, d):
    """Batches of all snapshots and how many of them are stored."""
    store, ids = _store(spark, d)
    every = catalog.union([store.manifest(i) for i in ids])
    return every.groupBy("table_name").agg(F.count("*").alias("n_batches"), F.countDistinct("batch_hash", "stored_in").alias("n_stored"))


def q_store_chunk(spark, d):
    return _store(spark, d)[0].chunk("orders", 0, 1).select("pos", "o_orderkey", "o_totalprice")


def q_store_verify(spark, d):
    store, ids = _store(spark, d)
    broken = store.verify(ids[1]).groupBy("table_name").agg(F.count("*").alias("broken"))
    return store.chunks(ids[1]).groupBy("table_name").agg(F.count("*").alias("n_chunks")).join(broken, "table_name", "left").na.fill(0)


def q_store_objects(spark, d):
    tables = catalog.unpack(_store(spark, d)[0].objects(), "table")
    return tables.select(F.col("name").alias("table_name"), F.explode("columns").alias("c")).select("table_name", "c.position", "c.name", "c.type")


def q_store_history(spark, d):
    return _store(spark, d)[0].history().select("seq", "kind", "name", "status")


def q_store_statements(spark, d):
    store, ids = _store(spark, d)
    return store.statements(ids[1]).select("phase", "step", "name", "statement")


def q_insert_statements(spark, d):
    df = load(spark, d, "customer")
    rows = manifest.placed(df, ["c_custkey"], CHUNK, BATCH, full=True)
    return ddl.insert_statements(rows, "public.customer", df.schema.fields, ["batch_no", "chunk_no"], ["pos"])


def q_object_status(spark, d):
    schema = "kind string, name string, ref string"
    return objects.object_status(_values(spark, OLD_OBJECTS, schema), _values(spark, NEW_OBJECTS, schema))


def q_dedup_report(spark, d):
    every = None
    for k in (1, 2, 3):
        part = manifest.chunk_manifest(manifest.placed(orders_v(spark, d, k), ["o_orderkey"], 50, 200)).select("chunk_hash")
        every = part if every is None else every.union(part)
    return every.agg(F.count("*").alias("n_chunks"), F.countDistinct("chunk_hash").alias("n_stored"))


def q_schema_columns(spark, d):
    return objects.columns_of(load(spark, d, "orders"), "orders").select("position", "name", "type", "nullable")


def _cols(spark, rows):
    return _values(spark, rows, "name string, type string, nullable boolean, default_value string, position int")


def q_schema_diff(spark, d):
    return diff.set_difference(_cols(spark, COLS_V1 + COLS_V1[1:2]), _cols(spark, COLS_V2))


def q_schema_merge(spark, d):
    v1, v2 = _cols(spark, COLS_V1), _cols(spark, COLS_V2)
    delta = diff.set_difference(v1, v2)
    return objects.merge_definitions(v1, delta.where("side = 'removed'").drop("side"), delta.where("side = 'added'").drop("side"), ["position"])


def _constraints(spark):
    return _values(spark, CONSTRAINTS, "table_name string, name string, type string, ordinal int, column_name string, definition string")


def q_constraint_fold(spark, d):
    return objects.fold_constraints(_constraints(spark))


def q_fk_fold(spark, d):
    return objects.fold_foreign_keys(_values(spark, FKS, "table_name string, name string, ordinal int, column_name string, referenced_table string, referenced_column string"))


def q_index_fold(spark, d):
    return objects.fold_indexes(_values(spark, INDEXES, "table_name string, name string, method string, is_unique boolean, predicate string, columns array<string>"), _constraints(spark))


def q_primary_key(spark, d):
    return objects.primary_key(_values(spark, TYPES, "table_name string, name string, type string"), _constraints(spark))


def q_pk_violations(spark, d):
    return validate.key_violations(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], primary=True)


def q_fk_orphans(spark, d):
    parents = load(spark, d, "orders").where("o_orderkey % 7 <> 0")
    return validate.orphans(load(spark, d, "lineitem").select("l_orderkey"), ["l_orderkey"], parents, ["o_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def q_not_null_violations(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"), "o_orderstatus")
    return validate.null_counts(df, ["o_orderpriority", "o_orderstatus"])


def q_check_violations(spark, d):
    return validate.check_violations(load(spark, d, "lineitem"), "l_quantity <= 45").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def q_integrity_check(spark, d):
    rows = _placed(load(spark, d, "orders"))
    hurt = rows.withColumn("row_hash", F.when(F.col("o_orderkey") == 700, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("row_hash")))
    return validate.broken_parts(manifest.chunk_manifest(rows), manifest.chunk_manifest(hurt), ["batch_no", "chunk_no"], "chunk_hash").select("batch_no", "chunk_no")


def q_dependency_order(spark, d):
    nodes = _values(spark, sorted({(x,) for e in EDGES for x in e}), "name string")
    return objects.dependency_levels(spark, nodes, _values(spark, EDGES, "name string, needs string"))


def q_missing_dependencies(spark, d):
    return objects.missing_dependencies(_values(spark, [("a",), ("b",), ("d",)], "name string"), _values(spark, EDGES, "name string, needs string"))


def q_normalize_text(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(text.normalize_definition(F.col("text")), 256).alias("text_hash"))


def q_normalize_routines(spark, d):
    return _values(spark, ROUTINES, "body string").select("body", text.normalize_definition(F.col("body")).alias("normal"))


def q_sql_literals(spark, d):
    df = load(spark, d, "customer")
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select("c_custkey", text.literal(F.when(F.col("c_nationkey") > 3, F.concat("c_name", F.lit("'s"))), kinds["c_name"]).alias("name_literal"),
                     text.literal(F.col("c_nationkey"), kinds["c_nationkey"]).alias("nation_literal"))


def q_split_name(spark, d):
    return _values(spark, NAMES, "name string").select("name", text.split_name(F.col("name")).alias("x")).select("name", F.col("x.schema").alias("schema_name"), F.col("x.object").alias("object_name"))


def q_quote_name(spark, d):
    return _values(spark, [("a",), ('b"c',)], "name string").select("name", text.quote_name(F.col("name")).alias("quoted"))


def q_ref_parse(spark, d):
    return _values(spark, OLD_OBJECTS, "kind string, name string, ref string").select("ref", text.ref_parts(F.col("ref")).alias("x")).select("ref", F.col("x.hash").alias("hash"), F.col("x.is_diff").alias("is_diff"))


def q_type_text(spark, d):
    rows = [("varchar", 16, None, None), ("numeric", None, 10, 2), ("integer", None, 32, 0), ("numeric", None, None, None)]
    return _values(spark, rows, "base string, n int, p int, s int").select("base", text.type_text(F.col("base"), F.col("n"), F.col("p"), F.col("s")).alias("type_text"))


def _sequences(spark, rows):
    df = spark.createDataFrame(rows, "name string, last_value long, increment long, max_value long, is_called boolean")
    return df.select("name", *(F.col(c).cast("decimal(38,0)").alias(c) for c in ("last_value", "increment", "max_value")), "is_called")


def q_field_patch(spark, d):
    return objects.field_patch(_sequences(spark, SEQ_V1), _sequences(spark, SEQ_V2), "name")


def q_apply_patch(spark, d):
    v1, v2 = _sequences(spark, SEQ_V1), _sequences(spark, SEQ_V2)
    return objects.apply_patch(v1, objects.field_patch(v1, v2, "name"), "name")


def q_sequence_restart(spark, d):
    return _sequences(spark, SEQ_V1).select("name", text.sequence_restart(F.col("last_value"), F.col("increment"), F.col("is_called")).alias("restart"))


def q_restore_plan(spark, d):
    return objects.restore_plan(_values(spark, KINDS, "kind string, name string"))


def _catalog(spark, version: int) -> DataFrame:
    """Objects of two versions of a small catalog: tables, sequences, routines."""
    columns = [("t", p, n, t, null, default) for n, t, null, default, p in (COLS_V1 if version == 1 else COLS_V2)] + [("u", 1, "j", "bigint", False, None)]
    columns = _values(spark, columns, "table_name string, position long, name string, type string, nullable boolean, default_value string")
    foreign = [(*k, "CASCADE", None) for k in FKS] if version == 1 else [(*FKS[2], None, None)]
    foreign = _values(spark, foreign, "table_name string, name string, ordinal long, column_name string, referenced_table string, referenced_column string, update_action string, delete_action string")
    indexes = _values(spark, [(*i[:3], k, c, *i[3:5]) for i in INDEXES for k, c in enumerate(i[5], 1)], "table_name string, name string, method string, ordinal long, column_name string, is_unique boolean, predicate string")
    tables = catalog.table_objects(columns, _constraints(spark).withColumn("ordinal", F.col("ordinal").cast("long")), foreign, indexes)
    sequences = _values(spark, [(n, "bigint", 1, 1, top, step, False, last, called) for n, last, step, top, called in (SEQ_V1 if version == 1 else SEQ_V2)],
                        "name string, type string, start long, min long, max long, increment long, cycle boolean, last_value long, is_called boolean")
    return catalog.union([tables, catalog.pack(sequences, "sequence"), _routines(spark, version)])


def _routine_rows(spark, version: int = 1):
    rows = [(*r[:-1], r[-1].replace("SELECT", "SELECT 1 +") if version == 2 and r[1] == "public.g" else r[-1]) for r in PROCS]
    return _values(spark, rows, "id long, name string, kind string, language string, volatility string, parameters string, return_type string, full_definition string")


def _routines(spark, version: int = 1):
    routines = _routine_rows(spark, version)
    edges = catalog.dependency_edges(_values(spark, DEPENDS, "id long, needs_id long, kind string"), routines)
    return catalog.routine_objects(routines, edges, _values(spark, TRIGGERS, "name string, definition string"))


def q_dependency_edges(spark, d):
    return catalog.dependency_edges(_values(spark, DEPENDS, "id long, needs_id long, kind string"), _routine_rows(spark))


def q_routine_parts(spark, d):
    return _routine_rows(spark).select("name", catalog.routine_parts(F.col("full_definition")).alias("x")).select("name", F.col("x.tag").alias("tag"), F.col("x.body").alias("body"))


def q_check_body(spark, d):
    return _values(spark, CHECKS, "definition string").select("definition", catalog.check_body(F.col("definition")).alias("body"))


def q_routine_objects(spark, d):
    found = catalog.unpack(_routines(spark), "function")
    return found.select("name", "language", "volatility", F.array_join("dependencies", ",").alias("dependencies"), "parameters", "return_type", "tag", "definition")


def q_table_objects(spark, d):
    found = catalog.unpack(_catalog(spark, 1), "table")
    names = lambda f: F.array_join(F.transform(f, lambda x: x["name"]), ",").alias(f)
    return found.select("name", names("columns"), names("constraints"), names("foreign_keys"), names("indexes"))


def q_object_deltas(spark, d):
    """Which fields of which objects changed, and by how many entries."""
    found = catalog.object_deltas(_catalog(spark, 1), _catalog(spark, 2)).select("kind", "name", F.explode("delta").alias("field", "x"))
    return found.select("kind", "name", "field", F.size("x.removed").alias("removed"), F.size("x.added").alias("added"))


def q_object_apply(spark, d):
    """Objects of the old version with their changes made, against those of the new one: none may differ."""
    old, new = _catalog(spark, 1), _catalog(spark, 2)
    made = catalog.apply_deltas(old, catalog.object_deltas(old, new))
    same = made.alias("a").join(new.alias("b"), ["kind", "name"])
    return same.groupBy("kind").agg(F.count("*").alias("n"), F.sum((F.col("a.hash") == F.col("b.hash")).cast("long")).alias("equal"))


def q_sequence_statements(spark, d):
    return ddl.sequence_statements(catalog.unpack(_catalog(spark, 1), "sequence")).select("phase", "step", "name", "statement")


def q_table_statements(spark, d):
    tables = catalog.unpack(_catalog(spark, 1), "table")
    return ddl.table_statements(tables).unionByName(ddl.rule_statements(tables)).select("phase", "step", "name", "statement")


def q_routine_statements(spark, d):
    found = _catalog(spark, 1)
    return catalog.union([catalog.unpack(found, k).select("name", ddl.routine_statement(k).alias("statement")) for k in catalog.ROUTINES])


def q_driver_values(spark, d):
    df = load(spark, d, "customer").select("c_custkey", F.encode(F.col("c_acctbal").cast("string"), "UTF-8").alias("v"))
    kind = F.element_at(F.array(*map(F.lit, ("numeric(10,2)", "bytea", "character varying(16)", "double precision"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    x = df.select("c_custkey", text.driver_value(F.col("v"), kind).alias("x"))
    return x.select("c_custkey", F.hex("x.bytes").alias("bytes"), F.col("x.number").alias("number"), F.col("x.text").alias("text"))


def q_parse_integers(spark, d):
    return _values(spark, INTEGERS, "t string").select("t", text.parse_integer(F.col("t")).cast("string").alias("n"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}


# SQL -------------------------------------------------------------------------------------------------------------------------

def _duck_row(table: str) -> str:
    """Canonical text of a row, in DuckDB's functions."""
    parts = []
    for name, letter in sorted(COLUMNS[table].items()):
        value = f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')" if letter == "t" else f"CAST({name} AS VARCHAR)"
        parts.append(f"'{name}=' || CASE WHEN {name} IS NULL THEN '~' ELSE '{letter}' || length({value}) || ':' || {value} END || ';'")
    return " || ".join(parts)


def _duck_version(k: int, table: str = "orders", key: str = "o_orderkey", measure: str = "o_totalprice") -> str:
    if k == 1:
        return f"(SELECT * FROM {table} WHERE {key} % 10 <> 9)"
    gone, hit = ("0, 7", "3, 5") if k == 3 else ("0", "3")
    return f"(SELECT * REPLACE (CASE WHEN {key} % 10 IN ({hit}) THEN {measure} + 1 ELSE {measure} END AS {measure}) FROM {table} WHERE {key} % 10 NOT IN ({gone}))"


_VP2 = f"""(SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders
  WHERE o_orderkey % 10 <> 9 AND o_orderkey <= (SELECT floor(max(o_orderkey) * {VP_SHARE}) FROM orders WHERE o_orderkey % 10 <> 9))"""


def _duck_placed(source: str, table: str = "orders", key: str | None = "o_orderkey", chunk: int = CHUNK, batch: int = BATCH) -> str:
    return f"""(SELECT *, rn // {chunk} AS chunk_no, rn % {chunk} AS pos, rn // {chunk} // {-(-batch // chunk)} AS batch_no FROM (
  SELECT *, row_number() OVER (ORDER BY {key or 'row_hash'}) - 1 AS rn FROM (SELECT *, sha256({_duck_row(table)}) AS row_hash FROM {source})))"""


def _duck_chunks(placed: str) -> str:
    return f"(SELECT batch_no, chunk_no, count(*) AS n_rows, sha256(string_agg(row_hash, '' ORDER BY pos)) AS chunk_hash FROM {placed} GROUP BY batch_no, chunk_no)"


def _duck_batches(chunks: str) -> str:
    return f"""(SELECT batch_no, count(*) AS n_chunks, CAST(sum(n_rows) AS BIGINT) AS n_rows, sha256(string_agg(chunk_hash, '|' ORDER BY chunk_no) || '|') AS batch_hash FROM {chunks} GROUP BY batch_no)"""


_OP = "CASE WHEN a.h IS NULL THEN 'I' WHEN b.h IS NULL THEN 'D' WHEN a.h <> b.h THEN 'U' END"


def _duck_diff(a: str, b: str, at: list[str], h: str) -> str:
    cols = ", ".join(at)
    side = lambda x: f"(SELECT {cols}, {h} AS h FROM {x})"
    return f"(SELECT * FROM (SELECT {cols}, {_OP} AS op, a.h AS old_hash, b.h AS new_hash FROM {side(a)} a FULL JOIN {side(b)} b USING ({cols})) WHERE op IS NOT NULL)"


def _duck_hashed(source: str, table: str) -> str:
    return f"(SELECT *, sha256({_duck_row(table)}) AS row_hash FROM {source})"


_POS = ["batch_no", "chunk_no", "pos"]
_P1, _P2, _ALL = _duck_placed(_duck_version(1)), _duck_placed(_VP2), _duck_placed("orders")
_POSDIFF = _duck_diff(_P1, _P2, _POS, "row_hash")
_V1, _V2, _V3 = (_duck_version(k) for k in (1, 2, 3))
_HURT = f"(SELECT * REPLACE (CASE WHEN o_orderkey = 700 THEN sha256('tampered') ELSE row_hash END AS row_hash) FROM {_ALL})"
_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(%s, '\s+', ' ', 'g')), '\s*,\s*', ', ', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '\s+;', ';', 'g')"""
_NORMAL = rf"CASE WHEN contains(%s, '--') THEN regexp_replace(%s, '^\s+|\s+$', '', 'g') ELSE {_NORMAL} END"
_SEQ_OLD, _SEQ_NEW = (_sql_values(x, "name, last_value, increment, max_value, is_called") for x in (SEQ_V1, SEQ_V2))
_COLS = "name, type, nullable, default_value, position"
_C1, _C2, _C1B = (_sql_values(x, _COLS) for x in (COLS_V1, COLS_V2, COLS_V1 + COLS_V1[1:2]))
_SPARK_TYPE = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"
_REMOVED = f"(SELECT batch_no, chunk_no FROM {_duck_chunks(_P1)} ANTI JOIN {_duck_chunks(_P2)} USING (batch_no, chunk_no))"
_DDL_COLUMNS = f"""string_agg('"' || column_name || '" ' || {_SPARK_TYPE}, ', ' ORDER BY ordinal_position)"""


def _duck_store_travel(k: int) -> str:
    return f"SELECT 's{k}' AS snapshot_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {_duck_version(k)}"


def _duck_literal(names: dict[str, str]) -> str:
    shown = [f"coalesce({'CAST(' + n + ' AS VARCHAR)' if kind != 's' else chr(39) * 4 + ' || replace(' + n + ', ' + chr(39) * 4 + ', ' + chr(39) * 6 + ') || ' + chr(39) * 4}, 'NULL')" for n, kind in names.items()]
    return "'(' || " + " || ', ' || ".join(shown) + " || ')'"


_CON = _sql_values(CONSTRAINTS, "table_name, name, type, ordinal, column_name, definition")

ORACLES = {
    "table_stats": f"SELECT count(*) AS n_rows, CAST(coalesce(max(octet_length(CAST(({_duck_row('orders')}) AS BLOB))), 0) AS BIGINT) AS max_row_size FROM orders",
    "batch_plan": f"""SELECT n AS n_rows, n AS max_row_size, greatest(b, 1) AS batch_size, greatest(CASE WHEN s < {manifest.WIDE_ROW} THEN greatest(b, 1) // 100 ELSE greatest(b, 1) // 10 END, 1) AS chunk_size
FROM (SELECT n, s, CASE WHEN s < {manifest.WIDE_ROW} THEN least({manifest.NARROW_BATCH} // s, {manifest.BATCH_ROWS}) ELSE {manifest.WIDE_BATCH} // s END AS b
  FROM (SELECT n, greatest(n, 1) AS s FROM (SELECT unnest([0, 1, 100, 210, 300000, {5 << 20}, {1 << 31}]) AS n)))""",
    "row_hash": f"SELECT c_custkey, sha256({_duck_row('customer')}) AS row_hash FROM customer",
    "row_hash_part": f"SELECT p_partkey, sha256({_duck_row('part')}) AS row_hash FROM part",
    "chunk_manifest": f"SELECT * FROM {_duck_chunks(_ALL)}",
    "batch_manifest": f"SELECT * FROM {_duck_batches(_duck_chunks(_ALL))}",
    "keyless_manifest": f"SELECT * FROM {_duck_chunks(_duck_placed('lineitem', 'lineitem', None))}",
    "keyset_first": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20",
    "keyset_page_single": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50",
    "keyset_page_composite": "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (3, 1) ORDER BY conv_id, turn LIMIT 40",
    "offset_page": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT * FROM lineitem ORDER BY ALL LIMIT 30 OFFSET 100)",
    "diff_keyed": f"SELECT * FROM {_duck_diff(_duck_hashed(_V1, 'orders'), _duck_hashed(_V2, 'orders'), ['o_orderkey'], 'row_hash')}",
    "diff_keyed_customer": "SELECT c_custkey, op FROM " + _duck_diff(*(_duck_hashed(_duck_version(k, "customer", "c_custkey", "c_acctbal"), "customer") for k in (1, 2)), ["c_custkey"], "row_hash"),
    "diff_positional": f"SELECT * FROM {_POSDIFF}",
    "diff_keyless": f"""WITH h AS (SELECT l_orderkey, sha256({_duck_row('lineitem')}) AS row_hash FROM lineitem),
a AS (SELECT row_hash FROM h WHERE l_orderkey % 10 <> 9), b AS (SELECT row_hash FROM h WHERE l_orderkey % 10 <> 0 UNION ALL SELECT row_hash FROM h WHERE l_orderkey % 10 = 1)
SELECT row_hash, 'D' AS op, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY row_hash
UNION ALL SELECT row_hash, 'I', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY row_hash""",
    "diff_summary": f"SELECT batch_no, chunk_no, op, count(*) AS n FROM {_POSDIFF} GROUP BY batch_no, chunk_no, op",
    "changed_chunks": f"SELECT batch_no, chunk_no, op FROM {_duck_diff(_duck_chunks(_P1), _duck_chunks(_P2), ['batch_no', 'chunk_no'], 'chunk_hash')}",
    "changed_batches": f"SELECT batch_no, op FROM {_duck_diff(_duck_batches(_duck_chunks(_P1)), _duck_batches(_duck_chunks(_P2)), ['batch_no'], 'batch_hash')}",
    "pruned_diff": f"SELECT * FROM {_POSDIFF}",
    "apply_diff": f"SELECT o_orderkey, o_totalprice FROM {_V2}",
    "diff_chain": f"SELECT o_orderkey, o_totalprice FROM {_V3}",
    "missing_targets": f"SELECT o_orderkey, 'D' AS op FROM {_V1} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_V2})",
    "tombstone_chunk": f"SELECT batch_no, chunk_no, pos, 'D' AS op, row_hash AS old_hash, CAST(NULL AS VARCHAR) AS new_hash FROM {_P1} SEMI JOIN {_REMOVED} USING (batch_no, chunk_no)",
    "new_chunk": f"SELECT batch_no, chunk_no, pos, 'I' AS op, CAST(NULL AS VARCHAR) AS old_hash, row_hash AS new_hash FROM {_P1} SEMI JOIN {_REMOVED} USING (batch_no, chunk_no)",
    "apply_positional": f"SELECT batch_no, chunk_no, pos, o_orderkey, row_hash FROM {_P2}",
    "stale_places": f"""SELECT a.batch_no, a.chunk_no, a.pos, a.row_hash AS old_hash, b.row_hash AS found_hash FROM {_P1} a LEFT JOIN {_P2} b USING (batch_no, chunk_no, pos)
WHERE b.row_hash IS DISTINCT FROM a.row_hash""",
    "page_cursor": "SELECT conv_id, turn FROM (SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) > (3, 1) ORDER BY conv_id, turn LIMIT 40) ORDER BY conv_id DESC, turn DESC LIMIT 1",
    "snapshot_log": "SELECT * FROM (VALUES (2::BIGINT, 's3', 'parquet', 2), (1, 's2', 'parquet', 2), (0, 's1', 'parquet', 2)) AS t(seq, message, engine, version) ORDER BY seq DESC",
    "time_travel_id": _duck_store_travel(2),
    "time_travel_exact_ts": _duck_store_travel(1),
    "time_travel_latest": _duck_store_travel(3),
    "time_travel_as_of": _duck_store_travel(2),
    "store_restore": f"SELECT * FROM {_V2}",
    "store_restore_keyless": "SELECT * FROM lineitem",
    "store_diff": f"SELECT * FROM {_duck_diff(_duck_hashed(_V1, 'orders'), _duck_hashed(_V2, 'orders'), ['o_orderkey'], 'row_hash')}",
    "store_changed_batches": "SELECT batch_no, op, new_hash FROM " + _duck_diff(*(_duck_batches(_duck_chunks(_duck_placed(v))) for v in (_V2, _V3)), ["batch_no"], "batch_hash"),
    "store_manifest": " UNION ALL ".join(f"SELECT 's{k}' AS snapshot_id, batch_no, n_chunks, n_rows, batch_hash FROM {_duck_batches(_duck_chunks(_duck_placed(_duck_version(k))))}" for k in (1, 2, 3)),
    "store_dedup": "SELECT 'orders' AS table_name, count(*) AS n_batches, count(DISTINCT batch_hash) AS n_stored FROM ("
    + " UNION ALL ".join(f"SELECT batch_hash FROM {_duck_batches(_duck_chunks(_duck_placed(_duck_version(k))))}" for k in (1, 2, 3))
    + """) UNION ALL SELECT 'customer', CAST(3 * ceil(count(*) / 500) AS BIGINT), CAST(2 * ceil(count(*) / 500) AS BIGINT) FROM customer
UNION ALL SELECT 'lineitem', CAST(2 * ceil(count(*) / 20000) AS BIGINT), CAST(ceil(count(*) / 20000) AS BIGINT) FROM lineitem""",
    "store_chunk": f"SELECT pos, o_orderkey, o_totalprice FROM {_duck_placed(_V3)} WHERE batch_no = 0 AND chunk_no = 1",
    "store_verify": f"""SELECT table_name, CAST(ceil(n / size) AS BIGINT) AS n_chunks, 0::BIGINT AS broken FROM (SELECT 'orders' AS table_name, (SELECT count(*) FROM {_V2}) AS n, {CHUNK} AS size
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 100 UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 1000)""",
    "store_objects": f"""SELECT table_name, CAST(ordinal_position AS BIGINT) AS position, column_name AS name, {_SPARK_TYPE} AS type FROM information_schema.columns WHERE table_name IN ('orders', 'customer')
UNION ALL SELECT 'customer', 6, 'c_note', 'string' UNION ALL SELECT table_name, ordinal_position, column_name, {_SPARK_TYPE} FROM information_schema.columns WHERE false""",
    "store_history": """SELECT CAST(seq AS BIGINT) AS seq, 'table' AS kind, name, status FROM (VALUES (0, 'orders', 'new'), (0, 'customer', 'new'), (0, 'lineitem', 'new'), (1, 'orders', 'unchanged'),
(1, 'customer', 'unchanged'), (1, 'lineitem', 'unchanged'), (2, 'orders', 'unchanged'), (2, 'customer', 'changed')) AS t(seq, name, status)""",
    "store_statements": f"""SELECT 1 AS phase, 'schema' AS step, 'public' AS name, 'CREATE SCHEMA IF NOT EXISTS "public"' AS statement
UNION ALL SELECT 2, 'table', table_name, 'CREATE TABLE "public"."' || table_name || '" (' || {_DDL_COLUMNS} || CASE table_name WHEN 'orders' THEN ', CONSTRAINT "orders_pk" PRIMARY KEY ("o_orderkey")'
  WHEN 'customer' THEN ', CONSTRAINT "customer_pk" PRIMARY KEY ("c_custkey")' ELSE '' END || ')' FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'lineitem') GROUP BY table_name""",
    "insert_statements": f"""SELECT batch_no, chunk_no, 'INSERT INTO "public"."customer" ({', '.join('"' + c + '"' for c in COLUMNS['customer'])}) VALUES ' || string_agg({_duck_literal(COLUMNS['customer'])}, ', ' ORDER BY pos) AS statement
FROM {_duck_placed('customer', 'customer', 'c_custkey')} GROUP BY batch_no, chunk_no""",
    "dependency_edges": f"""SELECT DISTINCT a.name, b.name AS needs FROM {_sql_values(DEPENDS, 'id, needs_id, kind')} d JOIN {_sql_values([p[:2] for p in PROCS], 'id, name')} a ON a.id = d.id
JOIN {_sql_values([p[:2] for p in PROCS], 'id, name')} b ON b.id = d.needs_id WHERE d.kind = 'n'""",
    "routine_parts": f"""SELECT name, regexp_extract(def, 'AS (\\$[^$]*\\$)', 1) AS tag, ltrim(split_part(def, regexp_extract(def, 'AS (\\$[^$]*\\$)', 1), 2), ' ' || chr(10)) AS body
FROM {_sql_values([(p[1], p[-1]) for p in PROCS], 'name, def')}""",
    "check_body": f"SELECT definition, nullif(regexp_extract(definition, 'CHECK \\((.*)\\)', 1), '') AS body FROM {_sql_values(CHECKS, 'definition')}",
    "routine_objects": f"""SELECT name, language, volatility, coalesce((SELECT string_agg(DISTINCT b.name, ',' ORDER BY b.name) FROM {_sql_values(DEPENDS, 'id, needs_id, kind')} d
  JOIN {_sql_values([p[:2] for p in PROCS], 'id, name')} b ON b.id = d.needs_id WHERE d.kind = 'n' AND d.id = p.id), '') AS dependencies, parameters, return_type,
  regexp_extract(def, 'AS (\\$[^$]*\\$)', 1) AS tag, {_NORMAL.replace('%s', "ltrim(split_part(def, regexp_extract(def, 'AS ([$][^$]*[$])', 1), 2), ' ' || chr(10))")} AS definition
FROM {_sql_values(PROCS, 'id, name, kind, language, volatility, parameters, return_type, def')} p WHERE kind = 'f'""",
    "table_objects": f"""SELECT c.name, c.columns, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM {_CON} k WHERE k.table_name = c.name AND NOT regexp_matches(k.name, '_not_null$')), '') AS constraints,
  coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM {_sql_values(FKS, 'table_name, name, o, c, r, rc')} k WHERE k.table_name = c.name), '') AS foreign_keys,
  coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM {_sql_values([i[:2] for i in INDEXES], 'table_name, name')} i WHERE i.table_name = c.name AND i.name NOT IN (SELECT name FROM {_CON})), '') AS indexes
FROM (SELECT 't' AS name, string_agg(name, ',' ORDER BY position) AS columns FROM {_C1} UNION ALL SELECT 'u', 'j') c""",
    "object_deltas": f"""SELECT 'sequence' AS kind, a.name, f.field, 1 AS removed, 1 AS added FROM {_SEQ_OLD} a JOIN {_SEQ_NEW} b USING (name), LATERAL (SELECT * FROM (VALUES ('last_value', a.last_value IS DISTINCT FROM b.last_value),
  ('increment', a.increment IS DISTINCT FROM b.increment), ('max', a.max_value IS DISTINCT FROM b.max_value), ('is_called', a.is_called IS DISTINCT FROM b.is_called)) AS v(field, differs)) f WHERE differs
UNION ALL SELECT 'table', 't', 'columns', (SELECT CAST(count(*) AS INT) FROM (SELECT * FROM {_C1} EXCEPT SELECT * FROM {_C2})), (SELECT CAST(count(*) AS INT) FROM (SELECT * FROM {_C2} EXCEPT SELECT * FROM {_C1}))
UNION ALL SELECT 'table', 't', 'foreign_keys', 1, 0 UNION ALL SELECT 'function', 'public.g', 'definition', 1, 1""",
    "object_apply": "SELECT * FROM (VALUES ('table', 2::BIGINT, 2::BIGINT), ('sequence', 3, 3), ('function', 2, 2), ('procedure', 1, 1), ('trigger', 1, 1)) AS t(kind, n, equal)",
    "sequence_statements": f"""SELECT 1 AS phase, 'sequence' AS step, name, 'CREATE SEQUENCE "public"."' || name || '" AS bigint START WITH 1 INCREMENT BY ' || increment || ' MINVALUE 1' ||
  coalesce(' MAXVALUE ' || max_value, ' NO MAXVALUE') || ' NO CYCLE' AS statement FROM {_SEQ_OLD}
UNION ALL SELECT 1, 'restart', name, 'ALTER SEQUENCE "public"."' || name || '" RESTART WITH ' || CASE WHEN is_called THEN last_value + increment ELSE last_value END FROM {_SEQ_OLD}""",
    "table_statements": """SELECT * FROM (VALUES
(2, 'table', 't', 'CREATE TABLE "public"."t" ("id" bigint NOT NULL, "name" varchar(16), "price" numeric(10,2) DEFAULT 0, CONSTRAINT "t_ck" CHECK (b > 0), CONSTRAINT "t_pk" PRIMARY KEY ("z", "b"))'),
(2, 'table', 'u', 'CREATE TABLE "public"."u" ("j" bigint NOT NULL, CONSTRAINT "u_pk" PRIMARY KEY ("j"), CONSTRAINT "u_uk" UNIQUE ("c"))'),
(4, 'foreign key', 't', 'ALTER TABLE "public"."t" ADD CONSTRAINT "t_fk" FOREIGN KEY ("a", "b") REFERENCES "public"."u" ("x", "y") ON UPDATE CASCADE ON DELETE NO ACTION'),
(4, 'index', 't', 'CREATE INDEX "t_ix" ON "public"."t" USING btree ("b", "a") WHERE b > 1'), (4, 'index', 'u', 'CREATE INDEX "u_ix" ON "public"."u" USING hash ("c")')) AS t(phase, step, name, statement)""",
    "routine_statements": """SELECT * FROM (VALUES ('public.f', 'CREATE FUNCTION public.f(a integer) RETURNS integer LANGUAGE sql AS $function$ SELECT a, public.g(a) $function$ IMMUTABLE'),
('public.g', 'CREATE FUNCTION public.g() RETURNS void LANGUAGE plpgsql AS $body$ BEGIN SELECT 1; END $body$'), ('sales.p', 'CREATE PROCEDURE sales.p() LANGUAGE sql AS $$ DELETE FROM t  $$'),
('trg', 'CREATE TRIGGER trg BEFORE INSERT ON t FOR EACH ROW EXECUTE FUNCTION f()')) AS t(name, statement)""",
    "driver_values": """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN hex(CAST(c_acctbal AS VARCHAR)::BLOB) END AS bytes, CASE WHEN c_custkey % 4 IN (0, 3) THEN c_acctbal END AS number,
CASE c_custkey % 4 WHEN 2 THEN CAST(c_acctbal AS VARCHAR) END AS text FROM customer""",
    "parse_integers": f"SELECT t, CASE WHEN regexp_matches(t, '^ *[+-]?[0-9]+ *$') THEN trim(t) END AS n FROM {_sql_values(INTEGERS, 't')}",
    "object_status": f"""SELECT kind, name, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'dropped' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS status
FROM (SELECT kind, name, regexp_replace(ref, '^diffs/', '') AS h FROM {_sql_values(OLD_OBJECTS, 'kind, name, ref')}) a
FULL JOIN (SELECT kind, name, regexp_replace(ref, '^diffs/', '') AS h FROM {_sql_values(NEW_OBJECTS, 'kind, name, ref')}) b USING (kind, name)""",
    "dedup_report": "SELECT count(*) AS n_chunks, count(DISTINCT chunk_hash) AS n_stored FROM (" + " UNION ALL ".join(
        f"SELECT chunk_hash FROM {_duck_chunks(_duck_placed(_duck_version(k), chunk=50, batch=200))}" for k in (1, 2, 3)) + ")",
    "schema_columns": f"SELECT CAST(ordinal_position AS INT) AS position, column_name AS name, {_SPARK_TYPE} AS type, true AS nullable FROM information_schema.columns WHERE table_name = 'orders'",
    "schema_diff": f"SELECT *, 'removed' AS side FROM (SELECT * FROM {_C1B} EXCEPT ALL SELECT * FROM {_C2}) UNION ALL SELECT *, 'added' FROM (SELECT * FROM {_C2} EXCEPT ALL SELECT * FROM {_C1B})",
    "schema_merge": f"SELECT * FROM {_C2}",
    "constraint_fold": f"SELECT table_name, name, type, coalesce(string_agg(column_name, ',' ORDER BY ordinal), '') AS columns, max(definition) AS definition FROM {_CON} WHERE NOT regexp_matches(name, '_not_null$') GROUP BY table_name, name, type",
    "fk_fold": f"""SELECT table_name, name, referenced_table, string_agg(column_name, ',' ORDER BY ordinal) AS columns, string_agg(referenced_column, ',' ORDER BY ordinal) AS referenced_columns
FROM {_sql_values(FKS, 'table_name, name, ordinal, column_name, referenced_table, referenced_column')} GROUP BY table_name, name, referenced_table""",
    "index_fold": "SELECT * FROM (VALUES ('t', 't_ix', 'btree', false, 'b > 1', 'b,a'), ('u', 'u_ix', 'hash', false, NULL, 'c')) AS t(table_name, name, method, is_unique, predicate, columns)",
    "primary_key": f"""SELECT c.table_name, c.name, string_agg(c.column_name, ',' ORDER BY ordinal) AS columns FROM {_CON} c LEFT JOIN {_sql_values(TYPES, 'table_name, column_name, type')} t
ON t.table_name = c.table_name AND t.column_name = c.column_name WHERE c.type = 'PRIMARY KEY' GROUP BY c.table_name, c.name
HAVING bool_and(coalesce(regexp_replace(t.type, '\\(.*\\)$', '') IN ({', '.join(repr(x) for x in [*objects.COMPARABLE, *objects.ALIASES])}), false))""",
    "pk_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL",
    "fk_orphans": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) GROUP BY l_orderkey",
    "not_null_violations": "SELECT 'o_orderpriority' AS column_name, count(*) FILTER (WHERE nullif(o_orderpriority, '1-URGENT') IS NULL) AS n FROM orders UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NULL) FROM orders",
    "check_violations": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_quantity <= 45) GROUP BY l_returnflag",
    "integrity_check": f"SELECT a.batch_no, a.chunk_no FROM {_duck_chunks(_ALL)} a JOIN {_duck_chunks(_HURT)} b ON a.batch_no = b.batch_no AND a.chunk_no = b.chunk_no WHERE a.chunk_hash <> b.chunk_hash",
    "dependency_order": f"""WITH RECURSIVE e AS {_sql_values(EDGES, 'name, needs')}, n AS (SELECT name FROM e UNION SELECT needs FROM e),
r AS (SELECT name, 0 AS level FROM n UNION ALL SELECT e.name, r.level + 1 FROM r JOIN e ON e.needs = r.name) SELECT name, max(level) AS level FROM r GROUP BY name""",
    "missing_dependencies": f"SELECT name, needs FROM {_sql_values(EDGES, 'name, needs')} WHERE needs NOT IN ('a', 'b', 'd')",
    "normalize_text": "SELECT doc_id, sha256(" + _NORMAL.replace("%s", "text") + ") AS text_hash FROM documents",
    "normalize_routines": "SELECT body, " + _NORMAL.replace("%s", "body") + f" AS normal FROM {_sql_values(ROUTINES, 'body')}",
    "sql_literals": """SELECT c_custkey, CASE WHEN c_nationkey > 3 THEN '''' || replace(c_name || '''s', '''', '''''') || '''' ELSE 'NULL' END AS name_literal,
coalesce(CAST(c_nationkey AS VARCHAR), 'NULL') AS nation_literal FROM customer""",
    "split_name": f"""SELECT name, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE 'public' END AS schema_name,
CASE WHEN contains(name, '.') THEN substr(name, instr(name, '.') + 1) ELSE name END AS object_name FROM {_sql_values(NAMES, 'name')}""",
    "quote_name": """SELECT name, '"' || replace(name, '"', '""') || '"' AS quoted FROM (VALUES ('a'), ('b"c')) AS t(name)""",
    "ref_parse": f"SELECT ref, regexp_replace(ref, '^diffs/', '') AS hash, starts_with(ref, 'diffs/') AS is_diff FROM {_sql_values(OLD_OBJECTS, 'kind, name, ref')}",
    "type_text": "SELECT * FROM (VALUES ('varchar', 'varchar(16)'), ('numeric', 'numeric(10,2)'), ('integer', 'integer'), ('numeric', 'numeric')) AS t(base, type_text)",
    "field_patch": "SELECT a.name, " + ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN b.{f} END AS {f}, a.{f} IS DISTINCT FROM b.{f} AS {f}_changed" for f in ("last_value", "increment", "max_value", "is_called"))
    + f" FROM {_SEQ_OLD} a JOIN {_SEQ_NEW} b ON a.name = b.name",
    "apply_patch": f"SELECT * FROM {_SEQ_NEW}",
    "sequence_restart": f"SELECT name, CASE WHEN is_called THEN last_value + increment ELSE last_value END AS restart FROM {_SEQ_OLD}",
    "restore_plan": f"SELECT kind, name, CASE kind WHEN 'sequence' THEN 1 WHEN 'table' THEN 2 WHEN 'rows' THEN 3 WHEN 'foreign key' THEN 4 WHEN 'index' THEN 4 ELSE 5 END AS phase FROM {_sql_values(KINDS, 'kind, name')}",
}
