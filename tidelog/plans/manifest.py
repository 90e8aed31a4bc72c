"""Numbered rows, chunks of rows, batches of chunks, and the manifests of their hashes."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import row_size, with_hash
from .shared import save, unused

#: Planner's limits, fixed values: bytes of a wide row, rows of a batch, bytes of a batch of narrow and of wide rows, chunks of each.
WIDE_ROW = 5 << 20
BATCH_ROWS = 100_000
NARROW_BATCH, NARROW_CHUNKS = 20 << 20, 100
WIDE_BATCH, WIDE_CHUNKS = 1 << 30, 10
#: Columns that place a row.
PLACES = ["row_hash", "batch_no", "chunk_no", "pos"]
#: Copies of one row that one task writes out.
SEGMENT = 1 << 16


def table_stats(df: DataFrame) -> DataFrame:
    """One row: n_rows and max_row_size (0 for an empty table), in one scan."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.max(row_size(df.schema)), F.lit(0)).cast("long").alias("max_row_size"))


def batch_plan(stats: DataFrame) -> DataFrame:
    """Rows of a batch and of a chunk by the widest row; both at least 1."""
    size = F.greatest("max_row_size", F.lit(1))
    batch = F.when(size < WIDE_ROW, F.least(F.floor(F.lit(NARROW_BATCH) / size), F.lit(BATCH_ROWS))).otherwise(F.floor(F.lit(WIDE_BATCH) / size))
    chunk = F.when(size < WIDE_ROW, F.floor(F.col("batch_size") / NARROW_CHUNKS)).otherwise(F.floor(F.col("batch_size") / WIDE_CHUNKS))
    return stats.withColumn("batch_size", F.greatest(batch, F.lit(1)).cast("long")).withColumn("chunk_size", F.greatest(chunk, F.lit(1)).cast("long"))


def _running(weight: str):
    """Adds to each row of a partition the sum of the weights before it, as the last column."""

    def run(batches):
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.get_field_index(weight))
            before = pc.add(pc.subtract(pc.cumulative_sum(own), own), total)
            total += pc.sum(own).as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, before], names=[*batch.schema.names, "before"])

    return run


def numbered(df: DataFrame, order: list, name: str = "rn", weight: str | None = None) -> DataFrame:
    """Rows numbered from 0 in global order, without a window over the whole table. With a weight, a row's number is the sum of
    the weights before it. df must have no column of that name.

    Rows are range-partitioned and sorted, and written once; a row's number is its place in its partition plus the rows of
    the partitions before, of which there is one small row each. The written table makes both reads see the same partitions.
    """
    at, part, rows, before = unused(df, "_at", "_part", "_rows", "_before")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    if weight is None:
        ranged = ranged.withColumn(at, F.monotonically_increasing_id())
        ranged = save(ranged.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1)), "numbered")
    else:
        ranged = ranged.mapInArrow(_running(weight), T.StructType([*df.schema.fields, T.StructField(at, T.LongType())]))
        ranged = save(ranged.withColumn(part, F.spark_partition_id().cast("long")), "numbered")
    counts = ranged.groupBy(part).agg((F.count("*") if weight is None else F.sum(weight)).alias(rows))
    # as many rows as partitions, so one task may add them up and all may have them
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, F.coalesce(F.sum(rows).over(earlier), F.lit(0)).alias(before))
    return ranged.join(F.broadcast(counts), part).withColumn(name, F.col(before) + F.col(at)).drop(at, part, before)


def _copies(rows: DataFrame, first: str, copies: str, name: str) -> DataFrame:
    """Each row as often as `copies` says, numbered from `first` on. Rows with very many copies are dealt to several tasks."""
    end, start = F.col(first) + F.col(copies) - 1, unused(rows, "_start")[0]
    few = rows.where(F.col(copies) <= SEGMENT).withColumn(name, F.explode(F.sequence(F.col(first), end)))
    many = rows.where(F.col(copies) > SEGMENT).withColumn(start, F.explode(F.sequence(F.col(first), end, F.lit(SEGMENT))))
    many = many.repartition(start).withColumn(name, F.explode(F.sequence(F.col(start), F.least(F.col(start) + (SEGMENT - 1), end))))
    return few.unionByName(many.drop(start))


def placed(df: DataFrame, keys: list[str] | None, chunk_size: int, batch_size: int | None = None, full: bool = False) -> DataFrame:
    """Rows with row_hash, batch_no, chunk_no and pos (within the chunk), in the order of the keys, or of the row hashes for a table without
    keys. Only the keys stay beside these, or all columns with full; a table that has one of these columns is refused.

    Only what is asked for is sorted and written. Equal rows of a table without keys are counted before the shuffle, so any number
    of them is one row there.
    """
    clash = {c.lower() for c in df.columns} & set(PLACES)
    if clash:
        raise ValueError(f"the table has columns named like places: {sorted(clash)}")
    hashed = with_hash(df)
    rn, first, copies, row = unused(df, "_rn", "_first", "_copies", "_row")
    if keys:
        rows = hashed if full else hashed.select(*(f"`{k}`" for k in keys), "row_hash")
        rows = numbered(rows, [F.col(f"`{k}`") for k in keys] + [F.col("row_hash")], rn)
    else:
        content = [F.first(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(row)] if full and df.columns else []
        rows = hashed.groupBy("row_hash").agg(*content, F.count("*").alias(copies))
        rows = _copies(numbered(rows, [F.col("row_hash")], first, copies), first, copies, rn)
        rows = rows.select("row_hash", rn, *([f"{row}.*"] if content else []))
    chunks = max(1, -(-(batch_size or 10 * chunk_size) // chunk_size))
    rows = rows.withColumn("chunk_no", F.floor(F.col(rn) / chunk_size).cast("long")).withColumn("pos", (F.col(rn) % chunk_size).cast("long"))
    return rows.withColumn("batch_no", F.floor(F.col("chunk_no") / chunks).cast("long")).drop(rn)


def _in_order(place: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x.getField(value))


def chunk_manifest(rows: DataFrame) -> DataFrame:
    """Rows (batch_no, chunk_no, n_rows, chunk_hash): SHA-256 over the row hashes in order. A group has chunk_size rows at most."""
    return rows.groupBy("batch_no", "chunk_no").agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(_in_order("pos", "row_hash"), ""), 256).alias("chunk_hash"))


def batch_manifest(chunks: DataFrame) -> DataFrame:
    """Rows (batch_no, n_chunks, n_rows, batch_hash): SHA-256 over chunk hashes in order, each followed by a bar."""
    return chunks.groupBy("batch_no").agg(F.count("*").alias("n_chunks"), F.sum("n_rows").alias("n_rows"),
                                          F.sha2(F.concat(F.array_join(_in_order("chunk_no", "chunk_hash"), "|"), F.lit("|")), 256).alias("batch_hash"))


def root_hash(batches: DataFrame, fan: int = 4096) -> str:
    """One SHA-256 over the batch hashes of a table in order, by way of one for each run of `fan` batches."""
    runs = batches.groupBy(F.floor(F.col("batch_no") / fan).alias("run")).agg(F.sha2(F.array_join(_in_order("batch_no", "batch_hash"), "|"), 256).alias("h"))
    return runs.agg(F.sha2(F.array_join(_in_order("run", "h"), "|"), 256)).first()[0]
