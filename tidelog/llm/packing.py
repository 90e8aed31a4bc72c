"""Packing token sequences: vector bin packing under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import texts
from .shared import ship
from .tokens import ChunkEncoder, _arrow

MAX_TOKENS = 1024
MAX_SEGMENTS = 32
MAX_LOSS = 1024
#: Items among which the next one is chosen.
POOL = 256
#: Sequences a partition may have.
PER_PARTITION = 1 << 40


class Packer:
    """Fills one sequence after another from a bounded pool of items.

    An item is a run of a document's ids with its demand (tokens, 1 segment, loss-bearing tokens). The next item of a sequence is
    that with the largest dot product of demand and free room, both as shares of the limits, among those that fit
    (ties: the older one). If none fits, the one with the largest product is cut to fit; the rest stays in the pool. Items longer
    than the pool's free slot need not wait: runs of max_tokens fill a sequence alone. A sequence that runs
    out of segments, loss or items below max_tokens is cut down to a power of two, which needs no padding, and what was cut off
    goes back to the pool, until nothing is left.
    """

    def __init__(self, max_tokens=MAX_TOKENS, max_segments=MAX_SEGMENTS, max_loss=MAX_LOSS, pool=POOL):
        if min(max_tokens, max_segments, max_loss) < 1 or max_tokens & (max_tokens - 1):
            raise ValueError("limits must be positive, max_tokens a power of two")
        self.caps, self.size = (max_tokens, max_segments, max_loss), pool
        self.items: list[tuple] = []  # (document, start, stop)
        self.need = np.zeros((0, 3))
        self.number = 0

    @staticmethod
    def _loss(doc, start, stop) -> int:
        """Loss-bearing ids in a run: those before the document's loss_stop, or by its running count of them."""
        return max(0, min(stop, doc[2]) - start) if isinstance(doc[2], int) else doc[2][stop] - doc[2][start]

    @staticmethod
    def _within(doc, start, most) -> int:
        """Ids from start on that hold at most `most` loss-bearing ones, most >= 1."""
        return most if isinstance(doc[2], int) else bisect_right(doc[2], doc[2][start] + most) - 1 - start

    def add(self, key, ids: bytes, n: int, loss: int | list[int]) -> Iterator[tuple]:
        """Take a document; yields pieces (key, start, length, ids, doc tokens, sequence, offset) of finished sequences. loss says which
        ids bear loss: those before a place, or a list of their numbers before each place and at the end."""
        doc, most = (key, ids, loss, n), self.caps[0]
        start = 0
        while n - start >= most and self._loss(doc, start, start + most) <= self.caps[2]:
            yield from self._seal([(doc, start, start + most)])
            start += most
        if start < n:
            self._put([(doc, start, n)])
        while len(self.items) >= self.size:
            yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.items:
            yield from self._fill()

    def _put(self, runs: list[tuple]) -> None:
        self.items += runs
        need = [(b - a, 1, self._loss(d, a, b)) for d, a, b in runs]
        self.need = np.vstack([self.need, np.array(need, float).reshape(-1, 3)])

    def _take(self, k: int) -> tuple:
        self.need = np.delete(self.need, k, axis=0)
        return self.items.pop(k)

    def _fill(self) -> Iterator[tuple]:
        caps = np.array(self.caps, float)
        free, runs = caps.copy(), []
        while self.items and free.min() >= 1:
            product = self.need @ (free / caps / caps)
            fits = (self.need <= free).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, product, -1)))
                run = self._take(k)
            else:
                k = int(np.argmax(product))
                doc, a, b = self._take(k)
                cut = min(int(free[0]), b - a)
                if self._loss(doc, a, a + cut) > free[2]:
                    cut = self._within(doc, a, int(free[2]))
                run = (doc, a, a + cut)
                self._put([(doc, a + cut, b)])
            runs.append(run)
            free -= (run[2] - run[1], 1, self._loss(*run))
        yield from self._seal(runs)

    def _seal(self, runs: list[tuple]) -> Iterator[tuple]:
        total = sum(b - a for _, a, b in runs)
        room = 1 << (total.bit_length() - 1)  # the largest power of two that the runs fill
        offset = 0
        for k, (doc, a, b) in enumerate(runs):
            stop = min(b, a + room - offset)
            yield doc[0], a, stop - a, doc[1][4 * a : 4 * stop], doc[3], self.number, offset
            offset += stop - a
            if offset == room:
                rest = [(doc, stop, b)] if stop < b else []
                self._put(rest + runs[k + 1 :])
                break
        self.number += 1


FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_WORKER: dict = {}


def _packed(documents: Iterable[tuple], id_type: pa.DataType, limits: tuple) -> Iterator[pa.RecordBatch]:
    """Pack (key, ids, loss) of one partition; sequence ids carry the partition's number."""
    packer, base = Packer(*limits), TaskContext.get().partitionId() * PER_PARTITION
    schema, rows = pa.schema([("id", id_type), *FIELDS]), []

    def batch():
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def pieces():
        for key, ids, loss in documents:
            yield from packer.add(key, ids, len(ids) // 4, loss)
        yield from packer.finish()

    for key, start, length, ids, n, number, offset in pieces():
        rows.append((key, start, length, ids, n, base + number, offset))
        if len(rows) >= 4096:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def pack_tokens(encoded: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, pool: int = POOL) -> DataFrame:
    """Pack rows (id, ids binary, loss_stop int: ids before it bear loss; null: all) into pieces (id, start, length, ids, doc_tokens,
    sequence_id, offset). Every id lies in exactly one piece. Rows without ids give no piece; repeated rows are packed
    each, under the same id; null ids of rows are kept, other columns are not read, an empty table gives no pieces. Each partition is packed by itself in one pass, so nothing is shuffled and no key
    can be hot; memory holds the pool and one batch.
    """
    ship(encoded.sparkSession)
    kind = _arrow(encoded.schema["id"].dataType)
    limits = (max_tokens, max_segments, max_loss, pool)

    def run(batches):
        def documents():
            for part in texts(batches, "id", "ids", "loss_stop"):
                for key, ids, stop in zip(*part):
                    if ids:
                        yield key, ids, len(ids) // 4 if stop is None else stop

        return _packed(documents(), kind, limits)

    return encoded.select("id", "ids", "loss_stop").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, {_SCHEMA}")


def rank_encoder(ranks: bytes, pattern: str, added: dict[str, int]) -> ChunkEncoder:
    """This worker's encoder by a rank file, equal to the tokenizers file of the same vocabulary."""
    if hash(ranks) not in _WORKER:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        _WORKER.clear()
        _WORKER[hash(ranks)] = ChunkEncoder(lambda s: array("I", encoding.encode_ordinary(s)).tobytes(), added, table[b"\n"])
    return _WORKER[hash(ranks)]


def pack_documents(docs: DataFrame, ranks: bytes, pattern: str, added: dict[str, int], id_col: str = "doc_id", text_col: str = "text",
                   separator: int = 0, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, pool: int = POOL) -> DataFrame:
    """Tokenize whole texts, end each with the separator, and pack them as pack_tokens does, in the same pass. The
    separator bears no loss. A null or empty text is the separator alone. Rows with a null id, and each of several rows with one id, are packed
    like others (their pieces bear the same id); other columns are not read; an empty table gives an empty result. ranks is
    broadcast; its size is that of the vocabulary."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    kind, limits = _arrow(id_type), (max_tokens, max_segments, max_loss, pool)
    data, end = docs.sparkSession.sparkContext.broadcast(ranks), array("I", [separator]).tobytes()

    def run(batches):
        encoder = rank_encoder(data.value, pattern, added)

        def documents():
            for keys, part in texts(batches, "id", "text"):
                for key, text in zip(keys, part):
                    ids = (encoder.encode(text) if text else b"") + end
                    yield key, ids, len(ids) // 4 - 1

        return _packed(documents(), kind, limits)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {id_type.simpleString()}, {_SCHEMA}")


def pack_examples(examples: DataFrame, ranks: bytes, pattern: str, added: dict[str, int], id_col: str = "id", parts_col: str = "parts", separator: int = 0,
                  max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, pool: int = POOL) -> DataFrame:
    """Pack instruction data: each row has its parts, structs (text, loss), whose texts are tokenized one by one; the ids of those
    with loss bear it, and the separator at the end does not. Pieces come as from pack_documents. Null parts and texts are empty, a null
    loss is false; rows with null ids, repeated rows and other columns are treated as there."""
    ship(examples.sparkSession)
    id_type = examples.schema[id_col].dataType
    kind, limits = _arrow(id_type), (max_tokens, max_segments, max_loss, pool)
    data, end = examples.sparkSession.sparkContext.broadcast(ranks), array("I", [separator]).tobytes()

    def run(batches):
        encoder = rank_encoder(data.value, pattern, added)

        def documents():
            for keys, rows in texts(batches, "id", "parts"):
                for key, parts in zip(keys, rows):
                    found = [(encoder.encode(p["text"]) if p["text"] else b"", bool(p["loss"])) for p in parts or [] if p]
                    bears = [loss for ids, loss in found for _ in range(len(ids) // 4)] + [False]
                    yield key, b"".join(ids for ids, _ in found) + end, list(accumulate(bears, initial=0))

        return _packed(documents(), kind, limits)

    chosen = examples.select(F.col(id_col).alias("id"), F.col(parts_col).alias("parts"))
    return chosen.mapInArrow(run, f"id {id_type.simpleString()}, {_SCHEMA}")
