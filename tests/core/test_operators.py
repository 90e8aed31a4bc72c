from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidelog import queries
from tidelog.functions import canonical, text
from tidelog.operators import diff, objects, validate
from tidelog.plans import manifest, shared

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES) and set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "customer", "part", "lineitem", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    plain = lambda x: x if x is None or isinstance(x, (str, bool)) else str(x) if isinstance(x, datetime) else round(float(x), 4)
    rows = lambda rs, at: sorted(repr([plain(r[k]) for k in at]) for r in rs)
    assert sorted(out.columns) == sorted(names)
    assert rows(out.collect(), sorted(names)) == rows(want.fetchall(), [names.index(c) for c in sorted(names)])


def test_canonical_text_tells_values_apart(spark):
    rows = [(None, None), ("", None), ("a;b=s1:x", None), ("~", None), (None, [1.5, None, float("nan")]), (None, []), (None, [0.0]), (None, [-0.0])]
    df = spark.createDataFrame(rows, "s string, a array<double>").withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("b", F.encode("s", "utf-8"))
    hashes = [r.row_hash for r in canonical.with_hash(df).collect()]
    assert len(set(hashes)) == 7 and hashes[-1] == hashes[-2]
    other = canonical.with_hash(df.select("m", "b", "a", "s")).collect()
    assert [r.row_hash for r in other] == hashes


def test_numbering_and_empty_tables(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = manifest.numbered(df, [F.col("k")]).collect()
    assert all(r.rn == r.k for r in out) and len(out) == 1000
    none = df.limit(0)
    assert manifest.table_stats(none).first().asDict() == {"n_rows": 0, "max_row_size": 0}
    assert manifest.chunk_manifest(manifest.placed(none, ["k"], 10)).count() == 0


def test_round_trip_of_changes(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", None)], "k int, s string, d double")
    b = spark.createDataFrame([(2, "y", 2.0), (3, "z", None), (4, None, None)], "k int, s string, d double")
    delta = diff.changes(a, b, ["k"])
    assert sorted((r.k, r.op) for r in delta.collect()) == [(1, "D"), (2, "U"), (4, "I")]
    assert sorted(map(repr, diff.apply_changes(a, delta, ["k"]).collect())) == sorted(map(repr, b.collect()))
    assert diff.changes(a, a, ["k"]).count() == 0 and diff.diff_keyless(a.union(a), a).agg(F.sum("n")).first()[0] == 3


def test_cycles_have_no_level(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "name string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("e", "d"), ("d", "gone")], "name string, needs string")
    got = {r.name: r.level for r in objects.dependency_levels(spark, nodes, edges.where("needs <> 'gone'")).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": 0, "e": 1}
    assert {r.name: r.level for r in objects.dependency_levels(spark, nodes, edges).collect()}["e"] is None


def test_deep_dependency_chains(spark):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(67)] + [("c",), (None,)], "name string")
    edges = spark.createDataFrame([(f"n{k}", f"n{k - 1}") for k in range(1, 67)] + [("c", "c")], "name string, needs string")
    got = {r.name: r.level for r in objects.dependency_levels(spark, nodes, edges).collect()}
    assert got == {f"n{k}": k for k in range(67)} | {"c": None, None: None}


def test_copies_of_one_row_are_counted_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SEGMENT", 7)
    df = spark.createDataFrame([("a",)] * 40 + [("b",)] + [("c",)] * 9, "s string")
    light, full = (manifest.placed(df, None, 6, 12, full=f) for f in (False, True))
    assert light.columns == ["row_hash", "chunk_no", "pos", "batch_no"] and sorted(full.select("s").collect()) == sorted(df.collect())
    want = sorted(r.row_hash for r in canonical.with_hash(df).collect())
    for rows in (light, full):
        got = sorted((r.chunk_no * 6 + r.pos, r.row_hash) for r in rows.collect())
        assert [h for _, h in got] == want and [k for k, _ in got] == list(range(50))
    assert manifest.chunk_manifest(light).count() == 9


def test_set_differences_keep_multiplicities(spark):
    a = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "k int, s string")
    b = spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (3, None)], "k int, s string")
    got = sorted((r.k, r.s, r.side) for r in diff.set_difference(a, b).collect())
    assert got == [(1, None, "removed"), (1, None, "removed"), (2, "x", "added"), (3, None, "added")]


def test_null_keys_equal_each_other(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 5), (2, 2)], "k int, v int")
    assert [(r.k, r.op) for r in diff.diff_keyed(a, b, ["k"]).collect()] == [(None, "U")]
    assert sorted(map(repr, diff.apply_changes(a, diff.changes(a, b, ["k"]), ["k"]).collect())) == sorted(map(repr, b.collect()))


def test_key_types(spark):
    types = {"a": "varchar(16)", "b": "timestamp(6) without time zone", "c": "json", "d": "TIMESTAMP", "e": "inet"}
    assert objects.comparable_key(types, ["a", "b", "d", "e"]) and not objects.comparable_key(types, ["a", "c"]) and not objects.comparable_key(types, [])
    columns = spark.createDataFrame([("t", n, k) for n, k in types.items()], "table_name string, name string, type string")
    keys = spark.createDataFrame([("t", "pk", "PRIMARY KEY", k, c, None) for k, c in enumerate("abde")], "table_name string, name string, type string, ordinal int, column_name string, definition string")
    assert objects.primary_key(columns, keys).first().columns == "a,b,d,e"


def test_checks_with_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (None, 2)], "a int, b int")
    assert validate.key_violations(df, ["a"]).count() == 1 and validate.key_violations(df, ["a"], primary=True).count() == 2
    assert validate.check_violations(df, "a > 1").count() == 2
    assert validate.orphans(df, ["a"], df.where("b = 2"), ["b"]).count() == 2


def test_statements():
    columns = [{"name": "id", "type": "bigint", "nullable": False}, {"name": 'a"b', "type": "text", "default": "''"}]
    assert text.create_table("s.t", columns, [{"name": "pk", "type": "PRIMARY KEY", "columns": ["id"]}, {"name": "c", "type": "CHECK", "definition": "id > 0"}]) == (
        'CREATE TABLE "s"."t" ("id" bigint NOT NULL, "a""b" text DEFAULT \'\', CONSTRAINT "pk" PRIMARY KEY ("id"), CONSTRAINT "c" CHECK (id > 0))')
    assert text.create_index("t", {"name": "i", "columns": ["a"], "unique": True, "predicate": "a > 1"}) == 'CREATE UNIQUE INDEX "i" ON "t" USING btree ("a") WHERE a > 1'
    assert "ON UPDATE CASCADE ON DELETE NO ACTION" in text.add_foreign_key("t", {"name": "f", "columns": ["a"], "referenced_table": "u", "referenced_columns": ["b"], "update_action": "CASCADE"})


def test_saved_tables_go_when_nothing_reads_them(spark):
    before = shared.saved_paths()
    with shared.scratch(spark):
        a, b = shared.save(spark.range(3), "a"), shared.save(spark.range(4), "b")
        shared.drop_unread(spark, shared.saved_paths()[len(before):], a.where("id > 0"))
        assert a.count() == 3 and shared.saved_paths()[len(before):] == [a._saved_at] and b._saved_at not in shared.saved_paths()
        kept = shared.save_result(lambda: shared.save(spark.range(5), "inner").where("id > 2"), spark, "kept")
        assert kept.count() == 2 and len(shared.saved_paths()) == len(before) + 2
    assert shared.saved_paths() == before and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_hashes_of_odd_doubles_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    odd = [None, 0.0, -0.0, 12.5, -999.99, 1e7, -12345678.9, 123456789012.34, 9999999999999998.0, 1e16, 1.5e16, 2.07779692837900006e18, 5e22, 1e23, 2.4363285028499998e288,
           0.001, 0.00012345, 1e-4, 9.999e-5, 1e-5, 1.5e-10, 1e-100, 5e-324, 1e-323, float("nan"), float("inf"), float("-inf")]
    rows = [(k, "c", 1, x, "m") for k, x in enumerate(odd)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = dict(con.execute(queries.ORACLES["row_hash"]).fetchall())
    got = {r.c_custkey: r.row_hash for r in queries.q_row_hash(spark, str(tmp_path)).collect()}
    assert [odd[k] for k in want if got[k] != want[k]] == [] and len(set(got.values())) == len(odd)
