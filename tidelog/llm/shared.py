"""What the operators share: tables in the cluster's shared folder, code for executors, component labels."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import drop, drop_unread, release, save, save_result, saved_paths, shared_dir

__all__ = ["connected_components", "drop", "drop_unread", "held_out", "join_groups", "lower_ascii", "meetings_of_tiles", "release", "sampled", "save", "save_result", "saved_paths", "shared_dir", "ship"]

_SHIPPED: set[str] = set()

#: Bound of the groups that a join treats as hot.
HOT_GROUPS = 1024

#: ASCII white space of the word contracts, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tidelog-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, str(source.relative_to(package.parent)))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(share: float, name: str, key: Column) -> Column:
    """True for about this share of all keys, by a hash of name and key; in steps fine enough for a bounded sample of any table."""
    steps = 1 << 48
    return F.pmod(F.xxhash64(F.lit(name), key), F.lit(steps)) < F.lit(int(min(1.0, share) * steps)).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int | None = None) -> DataFrame:
    """rows joined with their groups: groups has one row for each value of the columns `on`, and `size` counts the rows that have it.

    Groups with more than a share 1 / HOT_GROUPS of all rows (total, if it is known) are fewer than HOT_GROUPS, whatever the input, so they are broadcast
    and their rows stay where they are. The rows of all others are shuffled. Rows with a null in `on` meet no group and go. groups
    is read several times: save it, or let it be one aggregate whose shuffle is reused.
    """
    is_hot = F.col(size) * HOT_GROUPS > (groups.agg(F.sum(size)).scalar() if total is None else F.lit(total))
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return near.unionByName(far)


def meetings_of_tiles(rows: DataFrame, key: Column, own: Column, own_rows: Column, other_rows: Column, tile: int) -> DataFrame:
    """rows with (tile, i, j), one for each pair of tiles i <= j that a row takes part in, so that a task that compares two tiles holds
    at most 2 * tile rows, however many its group has (tiles are dealt by hash and filled so far that four deviations fit).

    A group's own rows meet all rows of the group, its other rows meet the own ones alone. own_rows and other_rows are the group's numbers of
    both, the same in all its rows. Own rows are dealt to the first tiles by the hash of key, others to those after.
    """
    at, mean = F.xxhash64(key), max(tile / 2, tile - 4 * tile**0.5)
    tiles = lambda n: F.when(n <= tile, F.signum(n)).otherwise(F.ceil(n / mean)).cast("int")
    rows = rows.withColumn("_h", tiles(own_rows)).withColumn("_v", tiles(other_rows)).where("_h > 0")
    place = F.when(own, F.pmod(at, F.col("_h"))).otherwise(F.col("_h") + F.pmod(at, F.greatest("_v", F.lit(1)))).cast("int")
    partners = F.sequence(F.lit(0), F.when(own, F.col("_h") + F.col("_v") - 1).otherwise(F.col("_h") - 1))
    rows = rows.withColumn("tile", place).withColumn("_p", F.explode(partners))
    return rows.withColumn("i", F.least("tile", "_p")).withColumn("j", F.greatest("tile", "_p")).drop("_h", "_v", "_p")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of edges (a, b): rows (node, component). Nulls and loops are ignored;
    an empty input gives an empty result.

    Alternating large-star and small-star rounds on DataFrames. Each round aggregates minima with partial
    aggregation and joins them back; the minima of nodes with a large share of all edges (hubs) are broadcast to the
    edges, so no task gets a hub's edges. Rounds end when the set of edges no longer changes; each is saved, so lineage stays short.
    """
    e = edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct()
    e = save(e, "cc")
    mark = _mark(e)
    while mark[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "v > u", mark[0]).selectExpr("v AS u", "least(u, m) AS v").where("u <> v")
        large = save(large.distinct(), "cc")
        moved = _with_least(large, "v <> m", mark[0]).selectExpr("greatest(v, m) AS u", "least(v, m) AS v")
        small = moved.union(large.groupBy("u").agg(F.min("v").alias("v")))
        last, e = e, save(small.distinct(), "cc")
        drop(last, large)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _with_least(e: DataFrame, condition: str, edges: int) -> DataFrame:
    """Rows (u, v, m) of e that meet the condition; m is the least v of u."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
    return join_groups(e, least, ["u"], "rows", edges).where(condition).select("u", "v", "m")


def _mark(e: DataFrame) -> tuple:
    """Count and order-free digest of a set of edges."""
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
