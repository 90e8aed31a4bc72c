import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tidelog.__main__ import main
from tidelog.operators import catalog, diff
from tidelog.sources import store as stores
from tidelog.sources.store import CorruptData, SnapshotMissing, Store, StoreError, StoreExists, StoreMissing
from tidelog.sources.tables import FolderTarget, JdbcSource, JdbcTarget, connection, is_empty
from tidelog.streaming.capture import capture

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture()
def orders(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    return df.where("o_orderkey % 10 <> 9"), df.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


def test_capture_restore_and_time_travel(spark, orders, tmp_path):
    store, (v1, v2) = Store(spark, f"file://{tmp_path}/s"), orders
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(300)
    keys = {"orders": ["o_orderkey"]}
    a = store.create({"orders": v1, "lineitem": lines}, keys, "one", sizes={"orders": (200, 20), "lineitem": (100, 10)})
    b = store.snapshot({"orders": v2, "lineitem": lines}, keys, "two")
    assert rows(store.table("orders", a)) == rows(v1) and rows(store.table("orders")) == rows(v2)
    assert store.restore(a, ordered=True)["orders"].collect() == v1.orderBy("o_orderkey").collect()
    assert rows(store.table("lineitem")) == rows(lines)
    assert [r.message for r in store.log().collect()] == ["two", "one"]
    first = store.log().where("seq = 0").first()
    assert store.find(first.ts.isoformat())["snapshot_id"] == a
    assert store.find("2999-01-01", as_of=True)["snapshot_id"] == b
    for at in ("2999-01-01", "00000000-0000-0000-0000-000000000000"):
        with pytest.raises(SnapshotMissing):
            store.find(at)
    ops = {r.op: r["count"] for r in store.diff("orders", a, b).groupBy("op").count().collect()}
    want = {r.op: r["count"] for r in diff.diff_keyed(v1, v2, ["o_orderkey"]).groupBy("op").count().collect()}
    assert ops == want and set(ops) == {"I", "U", "D"}
    assert store.diff("lineitem", a, b).count() == 0 and store.changed_batches("lineitem", a).count() == 0
    assert store.changed_batches("orders", a).count() > 0
    assert os.listdir(f"{tmp_path}/s/data/lineitem") and spark.read.parquet(f"{tmp_path}/s/data/lineitem/*").count() == 300  # stored once
    store.check(a)
    store.check()
    with pytest.raises(StoreExists):
        store.create({"orders": v1})
    assert store.vacuum() == 0


def test_tampering_is_found(spark, orders, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create({"orders": orders[0]}, {"orders": ["o_orderkey"]}, sizes={"orders": (500, 100)})
    folder = glob.glob(f"{tmp_path}/s/data/orders/*")[0]
    part = spark.read.parquet("file://" + folder)
    changed = part.withColumn("o_totalprice", F.col("o_totalprice") + (F.col("pos") == 5).cast("double"))
    rewritten = changed.collect()
    spark.createDataFrame(rewritten, part.schema).coalesce(1).write.mode("overwrite").parquet("file://" + folder)
    assert store.verify().count() > 0
    with pytest.raises(CorruptData):
        store.check()


def test_failure_leaves_no_snapshot(spark, orders, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    broken = orders[0].withColumn("x", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception):
        store.create({"orders": broken}, {"orders": ["o_orderkey"]}, sizes={"orders": (500, 100)})
    assert not store.exists()
    with pytest.raises(StoreMissing):
        store.log()
    with pytest.raises(StoreError):
        store.create({"orders": orders[0].withColumnRenamed("o_custkey", "pos")})


def test_empty_tables_nulls_and_new_columns(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    t = spark.createDataFrame([(1, None, [1.5, None]), (2, "", []), (3, "x;'", None)], "k int, s string, a array<double>")
    a = store.create({"t": t, "e": t.limit(0)}, {"t": ["k"]})
    wide = t.withColumn("extra", F.lit(5)).where("k > 1")
    store.snapshot({"t": wide, "e": t}, {"t": ["k"]})
    assert rows(store.table("t", a)) == rows(t) and store.table("e", a).count() == 0
    assert rows(store.table("t")) == rows(wide) and rows(store.table("e")) == rows(t)
    store.check()


def test_commands(spark, tmp_path, capsys):
    for name in ("region", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"file://{tmp_path}/in/{name}.parquet")
    path = f"file://{tmp_path}/s"
    assert main(["create", "--source", f"file://{tmp_path}/in", "--path", path, "--message", "hello", "--key", "region=r_regionkey"]) == 0
    assert main(["log", "--path", path]) == 0 and "hello" in capsys.readouterr().out
    assert main(["verify", "--path", path]) == 0
    assert main(["restore", "--path", path, "--target", f"file://{tmp_path}/out"]) == 0
    assert main(["restore", "--path", path, "--target", f"file://{tmp_path}/out"]) == 1  # not empty
    assert "CREATE TABLE" in spark.read.parquet(f"{tmp_path}/out/statements").where("name = 'region' AND step = 'table'").first().statement
    with pytest.raises(SystemExit):
        main(["restore", "--path", path, "--target", f"file://{tmp_path}/out2", "--from", "no time"])
    assert rows(spark.read.parquet(f"{tmp_path}/out/nation.parquet")) == rows(spark.read.parquet(f"{SF}/nation.parquet"))
    assert main(["log", "--path", f"file://{tmp_path}/none"]) == 1


def test_stream_capture(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for k, data in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 1, "old"), (3, 2, "d")]]):
        spark.createDataFrame(data, "k int, at int, v string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("k int, at int, v string").parquet(f"file://{tmp_path}/in")
        capture(stream, store, "t", ["k"], "at", f"file://{tmp_path}/cp").awaitTermination(120)
    assert rows(store.table("t").select("k", "v")) == rows(spark.createDataFrame([(1, "c"), (2, "b"), (3, "d")], "k int, v string"))
    assert store.log().count() == 2


def test_columns_of_any_name_come_back(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    names = ["k", "rn", "_at", "_part", "_before", "_rows", "_n", "op", "old_hash", "new_hash", "_rn", "_copies", "_first", "_row", "before", "side", "a b", "x.y"]
    rows_in = [tuple(range(n, n + len(names))) for n in (5, 1, 3)]
    t = spark.createDataFrame(rows_in, ", ".join(f"`{n}` int" for n in names))
    a = store.create({"keyed": t, "plain": t.union(t)}, {"keyed": ["k"]}, sizes={"keyed": (4, 2), "plain": (4, 2)})
    assert store.restore(a, ordered=True)["keyed"].collect() == t.orderBy("k").collect() and store.table("keyed").columns == names
    assert rows(store.table("plain")) == rows(t.union(t))
    store.check()
    assert store.diff("keyed", a).count() == 0
    with pytest.raises(StoreError):
        store.snapshot({"keyed": t.withColumn("row_hash", F.lit(1))})
    with pytest.raises(ValueError):
        diff.changes(t, t, ["k"])


def test_hashes_do_not_depend_on_the_session_zone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    t = spark.createDataFrame([(1, 1700000000), (2, 0), (3, None)], "k int, s long").select("k", F.timestamp_seconds("s").alias("t"))
    store.create({"t": t}, {"t": ["k"]})
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        store.check()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    store.check()


def test_one_snapshot_is_open_and_one_number_is_published_once(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    t = spark.range(5).toDF("k")
    one, two = Store(spark, path), Store(spark, path)
    one.create({"t": t}, {"t": ["k"]})
    one.begin()
    with pytest.raises(stores.TransactionInProgress):
        one.begin()
    with pytest.raises(stores.NoTransaction):
        two.commit()
    two.begin()
    for s in (one, two):
        s.add("t", t.where("k > 1"))
    one.commit("first", keep_others=True)
    with pytest.raises(stores.SnapshotConflict):
        two.commit("second")
    two.rollback()
    assert [r.message for r in one.log().collect()] == ["first", "snapshot"] and two.table("t").count() == 3
    one.check()
    two.snapshot({"t": t})
    assert one.table("t").count() == 5


def test_leftovers_go(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    t = spark.range(5).toDF("k")
    store.create({"t": t}, {"t": ["k"]})
    lost = Store(spark, store.path)
    lost.begin()
    lost.add("t", t.where("k > 2"))
    assert len(os.listdir(f"{tmp_path}/s/data/t")) == 2 and store.vacuum() == 1 and len(os.listdir(f"{tmp_path}/s/data/t")) == 1
    store.check()


def test_tampered_log_and_manifests_are_found(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create({"t": spark.range(50).toDF("k")}, {"t": ["k"]}, sizes={"t": (20, 5)})
    sid = store.find()["snapshot_id"]
    folder = f"file://{tmp_path}/s/manifests/{sid}"
    sound = spark.createDataFrame(spark.read.parquet(folder).collect(), spark.read.parquet(folder).schema)
    sound.where("batch_no > 0").coalesce(1).write.mode("overwrite").parquet(folder)
    assert store.verify_manifests() == ["t"]
    with pytest.raises(CorruptData):
        store.check()
    sound.coalesce(1).write.mode("overwrite").parquet(folder)
    store.check()
    name = f"{tmp_path}/s/log/{0:012d}.json"
    entry = json.loads(open(name).read())
    os.remove(name)
    crc = f"{tmp_path}/s/log/.{0:012d}.json.crc"
    if os.path.exists(crc):
        os.remove(crc)
    open(name, "w").write(json.dumps(entry | {"message": "other"}))
    with pytest.raises(CorruptData):
        store.log()


def objects_at(spark, version):
    from tidelog import queries

    return queries._catalog(spark, version)


def test_objects_are_kept_as_changes_and_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "LONGEST_CHAIN", 3)
    store, t = Store(spark, f"file://{tmp_path}/s"), spark.range(3).toDF("k")
    ids = [store.create({"t": t}, {"t": ["k"]}, objects=objects_at(spark, 1))]
    for n in range(6):
        made = objects_at(spark, 2 - n % 2).where("kind <> 'sequence'")
        counter = spark.createDataFrame([("c", n)], "name string, last_value long")
        ids.append(store.snapshot({"t": t}, objects=made.unionByName(catalog.pack(counter, "sequence"))))
    for n, sid in enumerate(ids):
        want = objects_at(spark, 1) if n == 0 else objects_at(spark, 1 + n % 2).where("kind <> 'sequence'")
        got = store.objects(sid).where("name <> 'c'")
        assert sorted((r.kind, r.name, r.hash) for r in got.collect()) == sorted((r.kind, r.name, r.hash) for r in want.collect())
        assert store.verify_objects(sid).count() == 0
        if n:
            assert catalog.unpack(store.objects(sid), "sequence").first().last_value == n - 1
    depths = [r.depth for r in store.refs().collect()]
    assert max(depths) <= 3 and store.refs(ids[3]).where("kind = 'sequence'").first().depth == 2
    # what had been there before is referred to, not stored again
    assert store.refs(ids[1]).where("name = 't'").first().ref == store.refs(ids[3]).where("name = 't'").first().ref
    status = {(r.kind, r.name): r.status for r in store.changed_objects(ids[0], ids[1]).collect()}
    assert status["table", "t"] == "changed" and status["sequence", "s1"] == "dropped" and status["sequence", "c"] == "new" and status["table", "u"] == "unchanged"
    with pytest.raises(stores.KindNotSupported):
        store.snapshot({"t": t}, objects=objects_at(spark, 1).withColumn("kind", F.lit("view")))
    store.check()


def test_statements_follow_dependencies(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create({}, objects=objects_at(spark, 1))
    made = [(r.phase, r.step, r.number, r.name) for r in store.statements().orderBy("phase", "number", "name").collect()]
    assert [m[3] for m in made if m[1] == "routine"] == ["public.g", "public.f", "sales.p", "trg"]
    assert {m[1]: m[0] for m in made} == {"schema": 1, "sequence": 1, "restart": 1, "table": 2, "foreign key": 4, "index": 4, "routine": 5}
    loop = spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "name string, dependencies array<string>")
    store.snapshot({}, objects=catalog.pack(loop, "function"))
    with pytest.raises(stores.MissingDependency):
        store.statements()


def test_chunks_are_read_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create({"t": spark.range(50).toDF("k")}, {"t": ["k"]}, sizes={"t": (20, 5)})
    assert [r.k for r in store.chunk("t", 1, 5).collect()] == list(range(25, 30))
    with pytest.raises(stores.ChunkMissing):
        store.chunk("t", 1, 3)
    with pytest.raises(stores.ChunkMissing):
        store.table("u")


@pytest.fixture()
def derby(spark, tmp_path):
    made = []

    def new(name):
        url = f"jdbc:derby:{tmp_path}/{name};create=true"
        made.append(f"jdbc:derby:{tmp_path}/{name};shutdown=true")
        return url, {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}

    yield new
    for url in made:
        try:
            spark._jvm.java.sql.DriverManager.getConnection(url)
        except Exception:  # shutting down is reported as an error
            pass


def test_a_database_goes_to_a_store_and_back(spark, derby, tmp_path):
    url, properties = derby("one")
    with connection(spark, url, properties) as c:
        for sql in ("CREATE SCHEMA shop", "CREATE TABLE shop.maker (id BIGINT NOT NULL CONSTRAINT maker_pk PRIMARY KEY, name VARCHAR(20) DEFAULT 'none')",
                    "CREATE TABLE shop.item (a INT NOT NULL, b VARCHAR(5) NOT NULL, maker BIGINT, price DECIMAL(10,2), made TIMESTAMP, CONSTRAINT item_pk PRIMARY KEY (b, a), "
                    "CONSTRAINT item_fk FOREIGN KEY (maker) REFERENCES shop.maker (id) ON DELETE CASCADE)",
                    "CREATE UNIQUE INDEX shop.item_price ON shop.item (price, a)", "CREATE SEQUENCE shop.seq AS BIGINT START WITH 5 INCREMENT BY 2 MINVALUE 1 MAXVALUE 99 NO CYCLE",
                    "INSERT INTO shop.maker VALUES (1, 'it''s'), (2, 'x')", "INSERT INTO shop.item VALUES (1, 'x', 1, 1.50, TIMESTAMP('2024-01-02 03:04:05.678')), (2, 'x', NULL, NULL, NULL), (1, '', 2, 0.10, NULL)",
                    "INSERT INTO shop.maker VALUES (NEXT VALUE FOR shop.seq, 'from 5')"):
            c.createStatement().execute(sql)
    source = JdbcSource(spark, url, properties)
    assert source.names() == ["SHOP.ITEM", "SHOP.MAKER"] and not is_empty(source)
    assert source.keys() == {"SHOP.ITEM": ["B", "A"], "SHOP.MAKER": ["ID"]}
    found = source.objects()
    item = catalog.unpack(found, "table").where("name = 'SHOP.ITEM'").first()
    assert [(c["name"], c["type"], c["nullable"]) for c in item["columns"]][:4] == [("A", "INTEGER", False), ("B", "VARCHAR(5)", False), ("MAKER", "BIGINT", True), ("PRICE", "DECIMAL(10,2)", True)]
    assert [(k["name"], k["referenced_table"], k["delete_action"]) for k in item["foreign_keys"]] == [("ITEM_FK", "SHOP.MAKER", "CASCADE")]
    assert [(i["name"], i["columns"], i["is_unique"]) for i in item["indexes"]] == [("ITEM_PRICE", ["PRICE", "A"], True)]
    sequence = catalog.unpack(found, "sequence").first()
    assert (sequence.name, sequence.increment, sequence.max) == ("SHOP.SEQ", 2, 99)

    store = Store(spark, f"file://{tmp_path}/s")
    store.create({n: source.table(n) for n in source.names()}, source.keys(), engine="jdbc", objects=found)
    store.check()
    other, _ = derby("two")
    target = JdbcTarget(spark, other, properties)
    with pytest.raises(stores.EngineMismatch):
        store.restore_to(FolderTarget(spark, f"file://{tmp_path}/out"))
    with pytest.raises(stores.NoTransaction):
        target.commit()
    store.restore_to(target)
    copy = JdbcSource(spark, other, properties)
    for name in source.names():
        assert rows(copy.table(name)) == rows(source.table(name))
    def plain(r):
        return r.name, r["columns"], [(c["type"], c["columns"]) for c in r["constraints"]], r["foreign_keys"], r["indexes"]

    assert sorted(map(repr, map(plain, catalog.unpack(copy.objects(), "table").collect()))) == sorted(map(repr, map(plain, catalog.unpack(found, "table").collect())))
    assert [r.last_value for r in catalog.unpack(copy.objects(), "sequence").collect()] == [7]
    with pytest.raises(stores.TargetNotEmpty):
        store.restore_to(target)


def test_a_failed_restore_is_undone(spark, derby, tmp_path):
    url, properties = derby("three")
    store = Store(spark, f"file://{tmp_path}/s")
    columns = spark.createDataFrame([("S.T", [(1, "K", "BIGINT", False, None)], [("F", ["K"], "S.NONE", ["K"], None, None)])],
                                    "name string, columns array<struct<position:bigint,name:string,type:string,nullable:boolean,default_value:string>>, "
                                    "foreign_keys array<struct<name:string,columns:array<string>,referenced_table:string,referenced_columns:array<string>,update_action:string,delete_action:string>>")
    store.create({"S.T": spark.range(3).toDF("K")}, {"S.T": ["K"]}, engine="jdbc", objects=catalog.pack(columns, "table"))
    target = JdbcTarget(spark, url, properties)
    with pytest.raises(Exception, match="NONE"):
        store.restore_to(target)
    assert JdbcSource(spark, url, properties).names() == [] and target.undo is None
    folder = FolderTarget(spark, f"file://{tmp_path}/out")
    folder.begin()
    with pytest.raises(stores.TransactionInProgress):
        folder.begin()
    folder.rows("t", spark.range(2))
    folder.rollback()
    assert folder.is_empty() and not glob.glob(f"{tmp_path}/out*")
