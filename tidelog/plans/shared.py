"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings while a table is saved: Spark deletes the shuffle files of a query at its end, and not when the driver happens to collect garbage;
#: and rows go to Python in batches that stay small when their texts are long.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}
#: Bytes of a row group of a saved table, which its writer holds, and its readers by columns.
_ROW_GROUP = 16 << 20

_OWN_DIR: dict[str, str] = {}
_SAVED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on one machine, an own folder."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIR:
        _OWN_DIR[key] = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return _OWN_DIR[key]


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once to the shared folder and read it back: later uses neither recompute it nor depend on the
    executors that made it, and the shuffle files of the way there go. release() deletes what was saved."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
    with _settings(spark):
        df.write.option("parquet.block.size", str(_ROW_GROUP)).parquet(path)
    _SAVED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that save() gave and that nothing will read any more."""
    for table in tables:
        path, spark = table._saved_at, table.sparkSession
        if path in _SAVED:
            _SAVED.remove(path)
            _delete(spark, path)


def saved_paths() -> list[str]:
    """Where the tables are that save() wrote and nobody deleted yet."""
    return list(_SAVED)


def drop_unread(spark: SparkSession, paths: list[str], by: DataFrame) -> None:
    """Delete saved tables, but those that `by` reads; a saved table's folder has a name that no other has."""
    read = by.inputFiles()
    for path in paths:
        folder = f"/{path.rsplit('/', 1)[1]}/"
        if path in _SAVED and not any(folder in f for f in read):
            _SAVED.remove(path)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def save_result(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """Save what make() gives, and delete the tables that it saved on the way."""
    before = len(_SAVED)
    out = save(make(), name)
    _SAVED.remove(out._saved_at)
    release(spark, before)
    _SAVED.append(out._saved_at)
    return out


def release(spark: SparkSession, after: int = 0) -> None:
    """Delete the tables that save() wrote, all but the first `after`; call it once the results that read them are stored."""
    while len(_SAVED) > after:
        _delete(spark, _SAVED.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved within are deleted at the end."""
    before = len(_SAVED)
    try:
        yield
    finally:
        release(spark, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
