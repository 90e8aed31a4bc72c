"""A store of snapshots: Parquet batches named by content, objects with their changes, manifests, and a log published last.

    PATH/log/NUMBER.json         one small signed file per snapshot, written to staging and renamed: the commit
    PATH/claims/NUMBER           made exclusively before that: two writers cannot publish one number
    PATH/manifests/ID/           (table_name, batch_no, batch_hash, n_chunks, n_rows, stored_in)
    PATH/chunks/ID/              (table_name, batch_no, chunk_no, n_rows, chunk_hash, batch_hash), for differences and checks
    PATH/data/TABLE/ID/          rows of the batches that snapshot ID was the first to have, with stored_in, batch_hash, chunk_in_batch and pos
    PATH/refs/ID/                (kind, name, hash, ref, depth): the snapshot's catalog objects; ref is a hash, or diffs/HASH for a change
    PATH/objects/ID/             objects that were new; PATH/changes/ID/ those that changed: (kind, name, hash, old_ref, delta)

Files are in few folders, whatever the number of batches; the manifest says in which.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ddl
from ..functions.text import DIFF_PREFIX, UUID_PATTERN
from ..operators import catalog, diff, objects, validate
from ..plans import manifest
from ..plans.shared import save, scratch

PLACE = ["chunk_in_batch", "pos"]
OWN = {*manifest.PLACES, *PLACE, "batch_hash", "stored_in"}
MESSAGE = "snapshot"
FORMAT = 2
#: Changes after which an object is stored whole again.
LONGEST_CHAIN = 8


class StoreError(Exception):
    """Any failure that a store reports."""


class StoreExists(StoreError):
    """create() found a store at its path."""


class StoreMissing(StoreError):
    """There is no store at the path."""


class SnapshotMissing(StoreError):
    """No snapshot has the id or lies at the time given."""


class ChunkMissing(StoreError):
    """A snapshot has no such chunk, batch or table."""


class CorruptData(StoreError):
    """Stored content does not match its hashes."""


class TransactionInProgress(StoreError):
    """A snapshot or restore is already open."""


class NoTransaction(StoreError):
    """No snapshot or restore is open."""


class SnapshotConflict(StoreError):
    """Another writer has published a snapshot meanwhile."""


class TargetNotEmpty(StoreError):
    """A restore needs an empty target."""


class EngineMismatch(StoreError):
    """The snapshot is from another engine than the target."""


class KindNotSupported(StoreError):
    """An object is of no known kind."""


class MissingDependency(StoreError):
    """A routine needs one that the snapshot lacks, or itself."""


LOG_SCHEMA = "seq long, snapshot_id string, ts timestamp, message string, engine string, version int"
MANIFEST = "batch_no long, n_chunks long, n_rows long, batch_hash string, stored_in string, table_name string"
CHUNKS = "batch_no long, chunk_no long, n_rows long, chunk_hash string, batch_hash string, table_name string"
REFS = "kind string, name string, hash string, ref string, depth int"
CHANGES = f"kind string, name string, hash string, old_ref string, delta {catalog.DELTA}"


def signature(entry: dict) -> str:
    """SHA-256 over a log entry without its signature."""
    return hashlib.sha256(json.dumps({k: v for k, v in entry.items() if k != "signature"}, sort_keys=True).encode()).hexdigest()


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._open: dict | None = None

    # files ------------------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _read(self, kind: str, ids: list[str], schema: str) -> DataFrame:
        paths = [p for i in ids if self._exists(p := f"{self.path}/{kind}/{i}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _publish(self, entry: dict) -> None:
        """Claim the entry's number, write it to staging and rename it: the snapshot is there wholly or not at all."""
        fs, claim = self._fs(f"{self.path}/claims/{entry['seq']:012d}")
        fs.mkdirs(claim.getParent())
        try:
            free = fs.createNewFile(claim)
        except Exception as e:
            raise SnapshotConflict(f"could not claim number {entry['seq']}") from e
        if not free:
            raise SnapshotConflict(f"number {entry['seq']} was published meanwhile")
        staging = f"{self.path}/staging/{entry['snapshot_id']}"
        fs, staged = self._fs(f"{staging}/entry.json")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/log/{entry['seq']:012d}.json")
        fs.mkdirs(final.getParent())
        if not fs.rename(staged, final):
            raise StoreError(f"could not publish {final}")
        self._delete(staging)

    def exists(self) -> bool:
        return self._exists(f"{self.path}/log")

    def _entries(self) -> list[dict]:
        """The log, one small entry per snapshot, oldest first; each is checked against its signature."""
        if not self.exists():
            raise StoreMissing(f"no store at {self.path}")
        out = []
        for name in self._names(f"{self.path}/log"):
            if not name.endswith(".json") or name.startswith("."):
                continue
            try:
                entry = json.loads(self._text(f"{self.path}/log/{name}"))
            except ValueError as e:
                raise CorruptData(f"log entry {name}") from e
            if entry.get("signature") != signature(entry):
                raise CorruptData(f"log entry {name}")
            out.append(entry)
        return out

    # capture ----------------------------------------------------------------------------------------------------------------

    def create(self, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, message: str = MESSAGE, sizes: dict | None = None,
               engine: str = "parquet", objects: DataFrame | None = None) -> str:
        """The first snapshot of a new store; its id. objects: catalog objects; those of the tables' own columns and keys if left out."""
        if self.exists():
            raise StoreExists(f"a store exists at {self.path}")
        return self._capture(tables, keys or {}, message, sizes or {}, engine, objects, False)

    def snapshot(self, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, message: str = MESSAGE, engine: str = "parquet",
                 objects: DataFrame | None = None, keep_others: bool = False) -> str:
        """Another snapshot. Batch and chunk sizes and keys stay those of the first snapshot that had the table. With
        keep_others, tables and objects that are not given stay as they were, and are not read."""
        if not self.exists():
            raise StoreMissing(f"no store at {self.path}")
        return self._capture(tables, keys or {}, message, {}, engine, objects, keep_others)

    def _capture(self, tables, keys, message, sizes, engine, found, keep_others) -> str:
        sid = self.begin()
        try:
            for name, df in tables.items():
                self.add(name, df, keys.get(name), sizes.get(name))
            known = {n: about["keys"] for n, about in self._open["known"].items()}
            self.add_objects(catalog.objects_of(self.spark, tables, known | keys) if found is None else found)
            self.commit(message, engine, keep_others)
        except BaseException:
            if self._open:
                self.rollback()
            raise
        return sid

    def begin(self) -> str:
        """Open a snapshot; its id. One may be open in a Store object; it is published by commit() or undone by rollback()."""
        if self._open:
            raise TransactionInProgress(f"snapshot {self._open['id']} is open")
        entries = self._entries() if self.exists() else []
        known: dict = {}
        for e in entries:
            known = e["tables"] | known
        last = max([e["seq"] for e in entries] + [int(n) for n in self._names(f"{self.path}/claims")], default=-1)
        self._open = {"id": str(uuid.uuid4()), "entries": entries, "known": known, "seq": last + 1, "tables": {}, "objects": 0}
        return self._open["id"]

    def _transaction(self) -> dict:
        if not self._open:
            raise NoTransaction("no snapshot is open")
        return self._open

    def add(self, name: str, df: DataFrame, key: list[str] | None = None, size: tuple | None = None) -> None:
        """Store a table's rows as part of the open snapshot; batches that the store has are not written again."""
        tx = self._transaction()
        clash = {c for c in df.columns if c.lower() in OWN}
        if clash:
            raise StoreError(f"{name} has columns of the store's own: {sorted(clash)}")
        plan = tx["known"].get(name) or self._plan(df, key, size)
        plan = {k: plan[k] for k in ("batch_size", "chunk_size", "keys")}
        with scratch(self.spark):
            root = self._save_table(tx, name, df, plan)
        tx["tables"][name] = plan | {"schema": df.schema.json(), "root": root}

    def _plan(self, df: DataFrame, key: list[str] | None, size: tuple | None) -> dict:
        if size is None:
            row = manifest.batch_plan(manifest.table_stats(df)).first()
            size = row.batch_size, row.chunk_size
        return {"batch_size": size[0], "chunk_size": size[1], "keys": key}

    def _save_table(self, tx: dict, name: str, df: DataFrame, plan: dict) -> str:
        sid = tx["id"]
        rows = manifest.placed(df, plan["keys"], plan["chunk_size"], plan["batch_size"], full=True)
        chunks = save(manifest.chunk_manifest(rows), "chunks")
        batches = save(manifest.batch_manifest(chunks), "batches")
        stored = self._read("manifests", [e["snapshot_id"] for e in tx["entries"]], MANIFEST).where(F.col("table_name") == name)
        stored = stored.groupBy("batch_hash").agg(F.min("stored_in").alias("there"))
        batches = save(batches.join(stored, "batch_hash", "left").withColumn("stored_in", F.coalesce("there", F.lit(sid))), "stored")
        named = F.lit(name).alias("table_name")
        batches.select("batch_no", "n_chunks", "n_rows", "batch_hash", "stored_in", named).write.mode("append").parquet(f"{self.path}/manifests/{sid}")
        chunks.join(batches.select("batch_no", "batch_hash"), "batch_no").select("batch_no", "chunk_no", "n_rows", "chunk_hash", "batch_hash", named).write.mode("append").parquet(f"{self.path}/chunks/{sid}")
        new = batches.where("there IS NULL").groupBy("batch_hash", "stored_in").agg(F.min("batch_no").alias("batch_no"))
        per_batch = max(1, -(-plan["batch_size"] // plan["chunk_size"]))
        out = rows.join(new, "batch_no").withColumn("chunk_in_batch", F.col("chunk_no") % per_batch)
        # batches lie together in a file, so that a file's range of batch hashes tells whether it is needed
        out = out.repartition("batch_hash").sortWithinPartitions("batch_hash", *PLACE)
        out.drop("batch_no", "chunk_no", "row_hash").write.mode("append").parquet(f"{self.path}/data/{name}/{sid}")
        return manifest.root_hash(batches) or ""

    def add_objects(self, found: DataFrame) -> None:
        """Store catalog objects as part of the open snapshot: new ones whole, changed ones as their change, unchanged ones as a reference."""
        tx = self._transaction()
        strange = found.where(~F.col("kind").isin(list(catalog.KINDS))).first()
        if strange:
            raise KindNotSupported(f"{strange.name} is a {strange.kind}")
        sid, entries = tx["id"], tx["entries"]
        with scratch(self.spark):
            now = save(found.select("kind", "name", "fields", "hash"), "objects")
            # a content that an earlier snapshot had keeps its reference, so that chains of changes end
            seen = self._read("refs", [e["snapshot_id"] for e in entries], REFS).groupBy("kind", "name", "hash").agg(F.min("ref").alias("seen"), F.min("depth").alias("seen_depth"))
            last = self._read("refs", [e["snapshot_id"] for e in entries[-1:]], REFS).select("kind", "name", F.col("ref").alias("old_ref"), F.col("depth").alias("old_depth"))
            both = now.join(last, ["kind", "name"], "left").join(seen, ["kind", "name", "hash"], "left")
            state = F.when(F.col("seen").isNotNull(), "seen").when(F.col("old_ref").isNull() | (F.col("old_depth") >= LONGEST_CHAIN), "whole").otherwise("changed")
            both = both.withColumn("state", state)
            ref = F.when(F.col("state") == "seen", F.col("seen")).when(F.col("state") == "whole", F.col("hash")).otherwise(F.concat(F.lit(DIFF_PREFIX), "hash"))
            depth = F.when(F.col("state") == "seen", F.col("seen_depth")).when(F.col("state") == "whole", 0).otherwise(F.col("old_depth") + 1)
            both = save(both.select("kind", "name", "fields", "hash", "old_ref", "state", ref.alias("ref"), depth.cast("int").alias("depth")), "refs")
            both.select("kind", "name", "hash", "ref", "depth").write.mode("append").parquet(f"{self.path}/refs/{sid}")
            both.where("state = 'whole'").select("kind", "name", "fields", "hash").write.mode("append").parquet(f"{self.path}/objects/{sid}")
            if entries:
                changed = catalog.object_deltas(self.objects(entries[-1]["snapshot_id"]), both.where("state = 'changed'").select("kind", "name", "fields", "hash"))
                changed = changed.select("kind", "name", "hash", "delta").join(both.select("kind", "name", "old_ref"), ["kind", "name"])
                changed.select("kind", "name", "hash", "old_ref", "delta").write.mode("append").parquet(f"{self.path}/changes/{sid}")
        tx["objects"] += 1

    def commit(self, message: str = MESSAGE, engine: str = "parquet", keep_others: bool = False) -> str:
        """Publish the open snapshot; its id."""
        tx = self._transaction()
        sid, last = tx["id"], tx["entries"][-1:] if keep_others else []
        tables = dict(tx["tables"])
        for e in last:
            kept = [n for n in e["tables"] if n not in tables]
            tables |= {n: e["tables"][n] for n in kept}
            for kind, schema in (("manifests", MANIFEST), ("chunks", CHUNKS)):
                self._read(kind, [e["snapshot_id"]], schema).where(F.col("table_name").isin(kept)).write.mode("append").parquet(f"{self.path}/{kind}/{sid}")
            with scratch(self.spark):
                here = save(self._read("refs", [sid], REFS).select("kind", "name"), "here")
                self._read("refs", [e["snapshot_id"]], REFS).join(here, ["kind", "name"], "left_anti").write.mode("append").parquet(f"{self.path}/refs/{sid}")
        entry = {"seq": tx["seq"], "snapshot_id": sid, "ts": datetime.now(timezone.utc).isoformat(timespec="microseconds"), "message": message or MESSAGE,
                 "engine": engine, "version": FORMAT, "tables": tables, "objects": self._objects_root(sid)}
        self._publish(entry | {"signature": signature(entry)})
        self._open = None
        return sid

    def _objects_root(self, sid: str) -> str:
        """SHA-256 over the names and hashes of a snapshot's objects; a catalog has few."""
        rows = self._read("refs", [sid], REFS).agg(F.array_sort(F.collect_list(F.struct("kind", "name", "hash", "ref"))).alias("all"))
        return rows.select(F.sha2(F.to_json("all"), 256)).first()[0]

    def rollback(self, snapshot_id: str | None = None) -> None:
        """Remove what an unpublished snapshot wrote, the open one if no id is given. Nothing refers to it."""
        sid = snapshot_id or self._transaction()["id"]
        if self.exists() and any(e["snapshot_id"] == sid for e in self._entries()):
            raise StoreError(f"snapshot {sid} is published")
        for kind in ("manifests", "chunks", "refs", "objects", "changes", "staging"):
            self._delete(f"{self.path}/{kind}/{sid}")
        for name in self._names(f"{self.path}/data"):
            self._delete(f"{self.path}/data/{name}/{sid}")
        if self._open and self._open["id"] == sid:
            self._open = None

    def vacuum(self) -> int:
        """Remove what unpublished snapshots left; their number. Not for use beside a running snapshot."""
        published = {e["snapshot_id"] for e in self._entries()}
        found = {i for kind in ("manifests", "chunks", "refs", "staging") for i in self._names(f"{self.path}/{kind}")}
        found |= {i for name in self._names(f"{self.path}/data") for i in self._names(f"{self.path}/data/{name}")}
        for sid in sorted(found - published):
            self.rollback(sid)
        return len(found - published)

    # reading ----------------------------------------------------------------------------------------------------------------

    def log(self) -> DataFrame:
        """Snapshots, newest first: (seq, snapshot_id, ts, message, engine, version)."""
        rows = [(e["seq"], e["snapshot_id"], datetime.fromisoformat(e["ts"]), e["message"], e["engine"], e["version"]) for e in self._entries()]
        return self.spark.createDataFrame(rows, LOG_SCHEMA).orderBy(F.desc("seq"))

    def find(self, at: str | datetime | None = None, as_of: bool = False) -> dict:
        """The snapshot with an id or exactly at a time, the newest at or before the time with as_of, or the latest."""
        entries = self._entries()
        if at is None:
            return entries[-1]
        if isinstance(at, str) and re.match(UUID_PATTERN, at):
            found = [e for e in entries if e["snapshot_id"] == at.lower()]
        else:
            when = datetime.fromisoformat(at) if isinstance(at, str) else at
            when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
            times = [(datetime.fromisoformat(e["ts"]), e) for e in entries]
            found = [e for t, e in times if (t <= when if as_of else t == when)]
        if not found:
            raise SnapshotMissing(f"no snapshot for {at}")
        return found[-1]

    def manifest(self, snapshot_id: str) -> DataFrame:
        return self._read("manifests", [snapshot_id], MANIFEST)

    def chunks(self, snapshot_id: str) -> DataFrame:
        return self._read("chunks", [snapshot_id], CHUNKS)

    def _rows(self, entry: dict, name: str, part: DataFrame | None = None) -> DataFrame:
        if name not in entry["tables"]:
            raise ChunkMissing(f"snapshot {entry['snapshot_id']} has no table {name}")
        schema = T.StructType.fromJson(json.loads(entry["tables"][name]["schema"]))
        part = self.manifest(entry["snapshot_id"]).where(F.col("table_name") == name) if part is None else part
        part = part.select("batch_no", "batch_hash", "stored_in")
        # one name for each snapshot that stored a batch of this one
        paths = [p for r in part.select("stored_in").distinct().collect() if self._exists(p := f"{self.path}/data/{name}/{r.stored_in}")]
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch_no", T.LongType()), *(T.StructField(c, T.LongType()) for c in PLACE)]))
        stored = T.StructType([*schema.fields, *(T.StructField(c, T.LongType()) for c in PLACE), *(T.StructField(c, T.StringType()) for c in ("batch_hash", "stored_in"))])
        return self.spark.read.schema(stored).parquet(*paths).join(part, ["batch_hash", "stored_in"]).drop("batch_hash", "stored_in")

    def table(self, name: str, at=None, as_of: bool = False) -> DataFrame:
        """A table as of a snapshot, its rows in no particular order."""
        return self._rows(self.find(at, as_of), name).drop("batch_no", *PLACE)

    def chunk(self, name: str, batch_no: int, chunk_no: int, at=None) -> DataFrame:
        """The rows of one chunk in order, with pos; only its batch is read."""
        entry = self.find(at)
        one = self.chunks(entry["snapshot_id"]).where((F.col("table_name") == name) & (F.col("batch_no") == batch_no) & (F.col("chunk_no") == chunk_no)).first()
        if not one:
            raise ChunkMissing(f"{name}: batch {batch_no}, chunk {chunk_no}")
        part = self.manifest(entry["snapshot_id"]).where((F.col("table_name") == name) & (F.col("batch_no") == batch_no))
        about = entry["tables"][name]
        per_batch = max(1, -(-about["batch_size"] // about["chunk_size"]))
        return self._rows(entry, name, part).where(F.col("chunk_in_batch") == chunk_no % per_batch).drop("batch_no", "chunk_in_batch").orderBy("pos")

    def restore(self, at=None, as_of: bool = False, ordered: bool = False) -> dict[str, DataFrame]:
        """All tables of a snapshot; with ordered, in the order of capture."""
        entry, out = self.find(at, as_of), {}
        for name in entry["tables"]:
            rows = self._rows(entry, name)
            out[name] = (rows.orderBy("batch_no", *PLACE) if ordered else rows).drop("batch_no", *PLACE)
        return out

    def refs(self, at=None) -> DataFrame:
        """References (kind, name, hash, ref, depth) to a snapshot's catalog objects."""
        return self._read("refs", [self.find(at)["snapshot_id"]], REFS)

    def objects(self, at=None) -> DataFrame:
        """Catalog objects (kind, name, fields, hash) of a snapshot: stored whole, or by the chain of changes since they were."""
        ids, refs = [e["snapshot_id"] for e in self._entries()], self.refs(at)
        changes, whole = self._read("changes", ids, CHANGES), self._read("objects", ids, catalog.OBJECT)
        depth = refs.agg(F.max("depth")).first()[0] or 0
        out = refs.select("kind", "name", "hash", "depth", F.col("ref").alias("at"))
        for k in range(depth):
            step = changes.select("kind", "name", F.concat(F.lit(DIFF_PREFIX), "hash").alias("at"), F.col("old_ref").alias(f"next{k}"), F.col("delta").alias(f"delta{k}"))
            out = out.join(step, ["kind", "name", "at"], "left").withColumn("at", F.coalesce(f"next{k}", "at")).drop(f"next{k}")
        base = whole.select("kind", "name", F.col("hash").alias("at"), "fields").dropDuplicates(["kind", "name", "at"])
        out = out.join(base, ["kind", "name", "at"], "left")
        for k in reversed(range(depth)):
            out = out.withColumn("fields", F.when(F.col(f"delta{k}").isNull(), F.col("fields")).otherwise(catalog.patched(F.col("fields"), F.col(f"delta{k}")))).drop(f"delta{k}")
        return out.select("kind", "name", "fields", "hash")

    # comparing --------------------------------------------------------------------------------------------------------------

    def diff(self, name: str, old, new=None) -> DataFrame:
        """Keyed difference of a table between two snapshots, or the multiset difference of one without keys."""
        a, b = self.find(old), self.find(new)
        keys = b["tables"][name]["keys"]
        x, y = self.table(name, a["snapshot_id"]), self.table(name, b["snapshot_id"])
        return diff.diff_keyed(x, y, keys) if keys else diff.diff_keyless(x, y)

    def changed_batches(self, name: str, old, new=None) -> DataFrame:
        pick = lambda at: self.manifest(self.find(at)["snapshot_id"]).where(F.col("table_name") == name)
        return diff.changed_parts(pick(old), pick(new), ["batch_no"], "batch_hash")

    def changed_objects(self, old, new=None) -> DataFrame:
        """new, changed, unchanged or dropped for each object of two snapshots."""
        return objects.object_status(self._by_hash(old), self._by_hash(new))

    def _by_hash(self, at) -> DataFrame:
        return self.refs(at).select("kind", "name", F.col("hash").alias("ref"))

    def history(self) -> DataFrame:
        """Rows (seq, kind, name, hash, status): each object in each snapshot, against the snapshot before."""
        entries = self._entries()
        every = catalog.union([self._read("refs", [e["snapshot_id"]], REFS).select(F.lit(e["seq"]).alias("seq"), "kind", "name", "hash") for e in entries])
        before = self.spark.createDataFrame([(b["seq"], a["seq"]) for a, b in zip(entries, entries[1:])], "seq long, last long")
        last = every.select(F.col("seq").alias("last"), "kind", "name", F.col("hash").alias("last_hash"))
        both = every.join(F.broadcast(before), "seq", "left").join(last, ["last", "kind", "name"], "left")
        status = F.when(F.col("last_hash").isNull(), "new").when(F.col("last_hash") == F.col("hash"), "unchanged").otherwise("changed")
        return both.select(F.col("seq").cast("long").alias("seq"), "kind", "name", "hash", status.alias("status"))

    # checking ---------------------------------------------------------------------------------------------------------------

    def verify(self, at=None) -> DataFrame:
        """Chunks of a snapshot whose stored rows do not give the hash of its manifest: (table_name, batch_no, chunk_no, ...); empty if all is well."""
        entry, bad = self.find(at), []
        for name, about in entry["tables"].items():
            per_batch = max(1, -(-about["batch_size"] // about["chunk_size"]))
            rows = self._rows(entry, name)
            content = [c for c in rows.columns if c not in {"batch_no", *PLACE}]
            hashed = manifest.with_hash(rows, columns=content).withColumn("chunk_no", F.col("batch_no") * per_batch + F.col("chunk_in_batch"))
            expected = self.chunks(entry["snapshot_id"]).where(F.col("table_name") == name)
            found = validate.broken_parts(expected, manifest.chunk_manifest(hashed), ["batch_no", "chunk_no"], "chunk_hash")
            bad.append(found.withColumn("table_name", F.lit(name)))
        empty = self.spark.createDataFrame([], "batch_no long, chunk_no long, expected_hash string, actual_hash string, table_name string")
        return reduce(DataFrame.unionByName, bad, empty)

    def verify_objects(self, at=None) -> DataFrame:
        """Catalog objects (kind, name) whose stored content does not give their hash."""
        found = self.objects(at)
        real = catalog.object_hash(F.col("kind"), F.col("name"), F.col("fields"))
        return found.where(F.col("fields").isNull() | (real != F.col("hash"))).select("kind", "name", "hash")

    def verify_manifests(self, at=None) -> list[str]:
        """Tables whose manifests are not those that the signed log entry names, and "objects" if the references are not."""
        entry, bad = self.find(at), []
        sid = entry["snapshot_id"]
        for name, about in entry["tables"].items():
            batches = self.manifest(sid).where(F.col("table_name") == name)
            chunks = self.chunks(sid).where(F.col("table_name") == name)
            folded = validate.broken_parts(batches, manifest.batch_manifest(chunks), ["batch_no"], "batch_hash")
            if (manifest.root_hash(batches) or "") != about["root"] or not folded.isEmpty():
                bad.append(name)
        return bad + (["objects"] if self._objects_root(sid) != entry["objects"] else [])

    def check(self, at=None) -> None:
        """Raises CorruptData unless log, manifests, objects and rows are as they were written."""
        bad = self.verify_manifests(at)
        if bad:
            raise CorruptData(f"manifest of {bad[0]}")
        first = self.verify_objects(at).first()
        if first:
            raise CorruptData(f"{first.kind} {first.name}")
        first = self.verify(at).first()
        if first:
            raise CorruptData(f"{first.table_name}: batch {first.batch_no}, chunk {first.chunk_no}")

    # restoring --------------------------------------------------------------------------------------------------------------

    def statements(self, at=None, postgres: bool = True) -> DataFrame:
        """Rows (phase, step, number, name, statement) that make a snapshot's objects, but its rows: schemas and sequences, tables, foreign keys
        and indexes, routines after those that they need. A routine that needs a missing one, or itself, is an error."""
        found = self.objects(at)
        sequences, tables = catalog.unpack(found, "sequence"), catalog.unpack(found, "table")
        parts = [ddl.schema_statements(sequences.select("name").union(tables.select("name")), postgres), ddl.sequence_statements(sequences, postgres),
                 ddl.table_statements(tables), ddl.rule_statements(tables, postgres), self._routine_statements(found)]
        return catalog.union(parts)

    def _routine_statements(self, found: DataFrame) -> DataFrame:
        nodes = found.where(F.col("kind").isin("function", "procedure")).select("name")
        edges = catalog.union([catalog.unpack(found, k).select("name", F.explode("dependencies").alias("needs")) for k in ("function", "procedure")])
        levels = save(objects.dependency_levels(self.spark, nodes, edges), "levels")
        lost = levels.where("level IS NULL").first()
        if lost:
            raise MissingDependency(f"{lost.name} cannot be restored: it needs what is not there, or itself")
        last = (levels.agg(F.max("level")).first()[0] or 0) + 1
        parts = []
        for kind in catalog.ROUTINES:
            routines = catalog.unpack(found, kind).select("name", ddl.routine_statement(kind).alias("statement"))
            routines = routines.join(levels, "name", "left") if kind != "trigger" else routines.withColumn("level", F.lit(last))
            parts.append(routines.select(F.lit(ddl.STEPS["routine"]).alias("phase"), F.lit("routine").alias("step"), F.col("level").cast("int").alias("number"), "name", "statement"))
        return catalog.union(parts)

    def restore_to(self, target, at=None, as_of: bool = False, any_engine: bool = False) -> dict:
        """Make a snapshot's objects and rows in an empty target, phase by phase; its log entry. What was made is undone on failure."""
        entry = self.find(at, as_of)
        if not any_engine and entry["engine"] != target.engine:
            raise EngineMismatch(f"the snapshot is of {entry['engine']}, the target {target.engine}")
        if not target.is_empty():
            raise TargetNotEmpty("the target is not empty")
        sid = entry["snapshot_id"]
        made = self.statements(sid, target.postgres)
        target.begin()
        try:
            target.run(made.where("phase <= 2"))
            for name in entry["tables"]:
                target.rows(name, self._rows(entry, name).drop("batch_no", *PLACE))
            target.run(made.where("phase = 4"))
            target.run(made.where("phase = 5"))
            target.commit()
        except BaseException:
            target.rollback()
            raise
        return entry
