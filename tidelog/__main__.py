"""Commands: create, snapshot, restore, log, verify."""

from __future__ import annotations

import argparse
import re
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from .functions.text import UUID_PATTERN
from .sources.store import Store, StoreError
from .sources.tables import open_source, open_target


def is_snapshot(text: str) -> bool:
    """Whether a text is a snapshot id or a time with a date."""
    if re.match(UUID_PATTERN, text):
        return True
    try:
        datetime.fromisoformat(text)
    except ValueError:
        return False
    return True


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("create", "snapshot"):
        c = sub.add_parser(name)
        c.add_argument("--source", required=True, help="jdbc:..., catalog:DATABASE or a folder of Parquet tables")
        c.add_argument("--path", required=True)
        c.add_argument("--message", default="")
        c.add_argument("--key", action="append", default=[], metavar="TABLE=COLUMN,...")
    c = sub.add_parser("restore")
    c.add_argument("--path", required=True)
    c.add_argument("--target", required=True, help="jdbc:... of an empty database, or a folder for Parquet tables that must not exist")
    c.add_argument("--any-engine", action="store_true", help="restore what another kind of source gave")
    c.add_argument("--from", dest="at", help="snapshot id or time; the latest if left out")
    for name in ("log", "verify"):
        sub.add_parser(name).add_argument("--path", required=True)
    a = p.parse_args(args)
    if a.command == "restore" and a.at and not is_snapshot(a.at):
        p.error("--from must be a snapshot id or a time")
    if any("=" not in x for x in getattr(a, "key", [])):
        p.error("--key must be TABLE=COLUMN,...")
    spark = SparkSession.builder.appName("tidelog").getOrCreate()
    store = Store(spark, a.path)
    try:
        if a.command in ("create", "snapshot"):
            source = open_source(spark, a.source)
            tables = {n: source.table(n) for n in source.names()}
            keys = source.keys() | {k: v.split(",") for k, v in (x.split("=", 1) for x in a.key)}
            unknown = set(keys) - set(tables)
            if unknown:
                raise StoreError(f"no table {sorted(unknown)[0]}")
            print(getattr(store, a.command)(tables, keys, message=a.message, engine=source.engine, objects=source.objects()))
        elif a.command == "restore":
            print(store.restore_to(open_target(spark, a.target), a.at, any_engine=a.any_engine)["snapshot_id"])
        elif a.command == "log":
            for r in store.log().collect():
                print(f"{r.snapshot_id}  {r.ts:%Y-%m-%d %H:%M:%S.%f}  {r.message}")
        else:
            store.check()
    except StoreError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
