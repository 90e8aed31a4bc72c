"""Jaccard join of documents by word n-grams: a count-vector R-tree finds pairs, and sets verify them.

The elements of a set are dealt by hash into groups, and the groups' counts are a point. The overlap of two sets is at most the sum of
the coordinate minima of their points, and for a node of the tree at most that with its upper corner, which prunes. Every link between
different sets is found by the search of such a tree. Equal sets are one point. What is in a tree together:

    First, documents with a min-hash in common, which are few. This settles most near copies at little cost, but may miss some.
    Then, documents of different components with a signature in common, which no pair can miss: a pair at the threshold differs in at
    most t elements, and t follows from its sizes. Dealt into more than t groups, one group at least is the same in both, so the
    pair shares a signature (size class, group, hash of the group's elements).

The signatures that meet different components are found by a minimum and a maximum for each. A document has a signature for each few
of its elements, so even a group with a third of all documents gives one signature but a small share of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import texts
from .shared import connected_components, drop, join_groups, meetings_of_tiles, save, ship

N = 5
PERCENT = 80
#: Coordinates of a point, a power of two.
GROUPS = 128
#: Rounds of min-hash.
ROUNDS = 3
#: Rows of a tree in these rounds, and rows of a tile of a signature, of which a task holds two.
BLOCK = 128
TILE = 1024
LEAF = 32
QUERIES = 128
#: Ratio of the limits of a size class.
RATIO = 1.5
#: Rows from which a signature is wide: a pair of documents that shares several wide ones is handed on at the least of them alone.
WIDE = 64
#: Pairs a task gathers before it hands them on.
PAIRS = 50_000
#: One document in SAMPLE tells which signatures may be hot: those of HOT or more documents among them, and of more than a share 1 / SHARE
#: of their signatures, so that hot signatures are at most SHARE numbers.
SAMPLE = 64
HOT = 32
SHARE = 1 << 19
#: Words a worker remembers the hash of.
MEMORY = 200_000
#: Bytes of the longest of these words.
MEMORY_LENGTH = 64

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x moves half of the bits of the result."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMORY_LENGTH:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of words [^\\x20\\x09-\\x0D]+, A-Z lower-cased; of the whole sequence if there are
    fewer words; empty without words."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, _U)
    for at in range(k):
        out *= _U(0x9E3779B97F4A7C15)
        out += h[at : len(h) - k + 1 + at]
    return np.unique(_mix(out))


def points(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> _U(65 - GROUPS.bit_length())).astype(np.int64), minlength=GROUPS)


def _pack(point: np.ndarray) -> bytes:
    """A point in one byte a coordinate, or in four where one is above 255."""
    return point.astype(np.uint8 if point.max() < 256 else "<u4").tobytes()


def _unpack(point: bytes) -> np.ndarray:
    return np.frombuffer(point, np.uint8 if len(point) == GROUPS else "<u4")


class Sizes:
    """Arithmetic of the threshold: similarity of at least percent / 100."""

    def __init__(self, percent: int):
        self.p = percent

    def smallest(self, size: int) -> int:
        """Size of the smallest set that can link with one of this size."""
        return -(-self.p * size // 100)

    def needed(self, a, b):
        """Least overlap of linked sets of these sizes."""
        return -(-self.p * (a + b) // (100 + self.p))

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b) or min(len(a), len(b)) < self.smallest(max(len(a), len(b))):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.p * (len(a) + len(b) - both)

    def classes(self, size: int) -> range:
        """Size classes of the smaller set of any pair that a set of this size can be in."""
        return range(size_class(self.smallest(size)), size_class(size) + 1)

    def differ(self, k: int) -> int:
        """Most elements in which a pair can differ whose smaller set is in class k."""
        most = math.ceil(RATIO ** (k + 1) + 1)
        return (100 - self.p) * (most + 100 * most // self.p) // (100 + self.p)


def size_class(size: int) -> int:
    return int(math.log(size) / math.log(RATIO) + 1e-9)


def signatures(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Hashes that two linked sets cannot both miss."""
    out = []
    for k in sizes.classes(len(s)):
        t = sizes.differ(k)
        groups = t + 1 if t == 0 else math.ceil(1.1 * (t + 1)) + 2
        g = (s & _U(0xFFFFFFFFFF)) % _U(groups)
        g = g.astype(np.uint16 if groups < 1 << 16 else np.int64)  # 16 bits are sorted by radix
        order = np.argsort(g, kind="stable")
        g = g[order]
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sums = np.add.reduceat(s[order], at)
        out.append(_mix(sums ^ (g[at].astype(_U) + _U(k + 1) * _U(0x100000001B3))))
        if len(at) <= t:  # all groups that are the same in both may be empty
            out.append(_mix(np.array([k], _U) * _U(0x100000001B3) + _U(0xE7037ED1A0B428DB)))
    return np.unique(np.concatenate(out))


class Forest:
    """Union by least label, over hashable labels."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (up := self.up.get(root, root)) != root:
            root = up
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class RTree:
    """Points and sizes in a tree of boxes, split at the median of the widest coordinate."""

    def __init__(self, pts: np.ndarray, n: np.ndarray, comp: np.ndarray, sizes: Sizes):
        self.pts, self.n, self.comp, self.sizes = pts, n, comp, sizes
        self.root = self._build(np.arange(len(n)))

    def _build(self, at: np.ndarray):
        pts, n, comp = self.pts[at], self.n[at], self.comp[at]
        upper, low, high = pts.max(axis=0), int(n.min()), int(n.max())
        only = comp[0] if (comp == comp[0]).all() else None
        if len(at) <= LEAF:
            return upper, low, high, only, at, None
        wide = np.vstack([pts.T, n[None, :]])
        order = at[np.argsort(wide[int(np.argmax(wide.max(axis=1) - wide.min(axis=1)))], kind="stable")]
        half = len(order) // 2
        return upper, low, high, only, None, (self._build(order[:half]), self._build(order[half:]))

    def search(self, pts: np.ndarray, n: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and of points of other components that may link. All queries go down together: those that a
        node's box cannot reach, or whose component alone is below it, stay behind."""
        left, right = [], []
        smallest = -(-self.sizes.p * n // 100)
        largest = 100 * n // self.sizes.p
        todo = [(self.root, np.arange(len(n)))]
        while todo:
            (upper, low, high, only, at, below), q = todo.pop()
            q = q[(low <= largest[q]) & (high >= smallest[q])]
            if only is not None:
                q = q[comp[q] != only]
            q = q[np.minimum(pts[q], upper).sum(axis=1, dtype=np.int64) >= self.sizes.needed(n[q], np.maximum(low, smallest[q]))]
            if not len(q):
                continue
            if at is None:
                todo += [(node, q) for node in below]
                continue
            for k in range(0, len(q), QUERIES):
                part = q[k : k + QUERIES]
                over = np.minimum(pts[part][:, None, :], self.pts[at][None, :, :]).sum(axis=2, dtype=np.int64)
                keep = (over >= self.sizes.needed(n[part][:, None], self.n[at][None, :])) & (comp[part][:, None] != self.comp[at][None, :])
                keep &= (self.n[at][None, :] >= smallest[part][:, None]) & (self.n[at][None, :] <= largest[part][:, None])
                i, j = np.nonzero(keep)
                left.append(part[i])
                right.append(at[j])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _runs(batches, names: list[str], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of neighbouring rows with the same first `keys` columns."""
    rows = (row for part in texts(batches, *names) for row in zip(*part))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(group)


def _sketch(docs: DataFrame, n: int, sizes: Sizes) -> DataFrame:
    """Rows (id, n, f1, f2, keys, sigs, counts): size, fingerprint, min-hashes, signatures and point of each document's set."""
    seeds = _mix(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)

    def run(batches):
        for ids, part in texts(batches, "id", "text"):
            rows = []
            for text in part:
                s = shingles(text, n)
                if not len(s):
                    rows.append((0, 0, 0, None, None, None))
                    continue
                f1, f2 = np.add.reduce(s).astype(np.int64), np.bitwise_xor.reduce(s).astype(np.int64)
                keys = (s[None, :] * seeds[:, None]).min(axis=1).view(np.int64)
                rows.append((len(s), f1, f2, keys, signatures(s, sizes).view(np.int64), _pack(points(s))))
            c = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, k) for x, k in zip(c, kinds))], names=["id", "n", "f1", "f2", "keys", "sigs", "counts"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>, sigs array<long>, counts binary")


def _verified_edges(blocks: DataFrame, n: int, sizes: Sizes) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links within each block of rows (round, key, block, id, text), which the block's tree finds."""
    names = ["round", "key", "block", "id", "text"]

    def run(batches):
        for _, group in _runs(batches, names, 3):
            if len(group) < 2:
                continue
            ids, sets = [r[3] for r in group], [shingles(r[4], n) for r in group]
            length, pts, every = np.array([len(s) for s in sets]), np.array([points(s) for s in sets]), np.arange(len(sets))
            left, right = RTree(pts, length, every, sizes).search(pts, length, every)
            forest, out = Forest(), []
            for i, j in sorted((i, j) for i, j in zip(left.tolist(), right.tolist()) if i > j):
                if forest.find(i) != forest.find(j) and sizes.links(sets[i], sets[j]):
                    forest.join(i, j)
                    out.append((ids[i], ids[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    by = ["round", "key", "block"]
    return blocks.select(*names).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def _meetings(sigs: DataFrame) -> DataFrame:
    """Rows (sig, id, comp, rows) of the signatures that meet several components, of rows (id, comp, sig); rows is the signature's number of rows.

    Hot signatures are aggregated before their shuffle and joined back if they are needed; all others are shuffled once, to a window. A
    sample tells which are hot, so it decides on the way that a signature takes and not on the result.
    """
    counts = save(sigs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("sig").count(), "sampled")
    hot = counts.where((F.col("count") >= HOT) & (F.col("count") > counts.agg(F.sum("count") / SHARE).scalar())).select("sig")
    span = [F.min("comp"), F.max("comp"), F.count("*")]
    same = Window.partitionBy("sig")
    cold = sigs.join(F.broadcast(hot), "sig", "left_anti").select("*", *(c.over(same).alias(n) for c, n in zip(span, ("lo", "hi", "rows"))))
    met = sigs.join(F.broadcast(hot), "sig", "left_semi").groupBy("sig").agg(*(c.alias(n) for c, n in zip(span, ("lo", "hi", "rows"))))
    # met has a row for each hot signature
    warm = sigs.join(F.broadcast(met.where("lo <> hi")), "sig")
    names = ["sig", "id", "comp", "rows"]
    return cold.where("lo <> hi").select(*names).union(warm.select(*names))


def _candidates(tiles: DataFrame, sizes: Sizes) -> DataFrame:
    """Pairs (a, b) of different components that the tree of each tile leaves, of rows (sig, i, j, tile, id, comp, n, counts, wide): the rows
    of tile i are in the tree, those of tile j search it. wide holds a document's wide signatures where sig is one, so that each pair leaves one
    wide signature and not all that it shares."""
    names = ["sig", "i", "j", "tile", "id", "comp", "n", "counts", "wide"]

    def run(batches):
        found: set[tuple[int, int]] = set()

        def flush():
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in (0, 1)], names=["a", "b"])

        for (sig, i, j), group in _runs(batches, names, 3):
            tile, ids, comp, n = (np.array([r[k] for r in group]) for k in (3, 4, 5, 6))
            mine, theirs = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
            if not len(mine) or not len(theirs) or len(group) < 2:
                continue
            pts = np.array([_unpack(r[7]) for r in group])
            at, by = RTree(pts[mine], n[mine], comp[mine], sizes).search(pts[theirs], n[theirs], comp[theirs])
            at, by = theirs[at], mine[by]
            if group[0][8] is not None and len(at):
                wide = [set(r[8]) for r in group]
                least = [min(wide[x] & wide[y]) == sig for x, y in zip(at.tolist(), by.tolist())]
                at, by = at[least], by[least]
            found.update(zip(np.minimum(ids[at], ids[by]).tolist(), np.maximum(ids[at], ids[by]).tolist()))
            if len(found) > PAIRS:
                yield flush()
        yield flush()

    by = ["sig", "i", "j"]
    return tiles.select(*names).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct()


def _verified_pairs(pairs: DataFrame, docs: DataFrame, n: int, sizes: Sizes) -> DataFrame:
    """The pairs (a, b) whose documents link."""
    left = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for a, b, x, y in texts(batches, "a", "b", "text_a", "text_b"):
            sets = {}
            out = []
            for i, j, s, t in zip(a, b, x, y):
                for text in (s, t):
                    if text not in sets:
                        sets[text] = shingles(text, n)
                if sizes.links(sets[s], sets[t]):
                    out.append((i, j))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """Rows (id, n_shingles, component_id): size of each document's set of word n-grams, and the smallest id that it reaches by
    links; two documents link when their sets have a Jaccard similarity of at least percent / 100.

    Null and empty texts have no elements and link with nothing, nor do rows with a null id (their component is null). Rows that
    share an id are one node, which links as any of them does. Repeated rows stay; other columns are not read. An empty table gives an empty result.

    No cap: every pair that can link shares a signature, and every signature that meets several components is searched whole, tile
    by tile if it is large: rows of its most frequent component meet all others, and those meet each other too.
    """
    ship(docs.sparkSession)
    sizes = Sizes(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = save(_sketch(docs, n, sizes), "sketch")
    with_set = sketch.where("n > 0 AND id IS NOT NULL")
    # equal sets are one class, its smallest id stands for it
    classes = save(with_set.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    named = save(join_groups(with_set.select("id", "n", "f1", "f2"), classes, ["n", "f1", "f2"], "copies").select("id", "n", "rep"), "named")
    empty = save(sketch.where("n = 0 OR id IS NULL").select("id", F.col("n").alias("n_shingles")), "empty")
    reps = named.where("id = rep").select("id", "n").distinct()

    # rounds of min-hash: trees of a key
    keys = with_set.select("id", "n", "keys").join(reps, ["id", "n"], "left_semi")
    keys = save(keys.select("id", F.posexplode("keys").alias("round", "key")), "keys")
    shared = save(keys.groupBy("round", "key").agg(F.count("*").alias("rows")).where("rows > 1"), "shared")
    members = join_groups(keys, shared, ["round", "key"], "rows")
    members = members.withColumn("block", F.pmod(F.xxhash64("id", "round"), F.ceil(F.col("rows") / BLOCK)).cast("int"))
    blocks = members.select("round", "key", "block", "id").join(docs, "id")
    edges = save(_verified_edges(blocks, n, sizes), "edges")
    drop(keys, shared)
    joined = connected_components(edges)

    # what no signature may miss: those that meet several components
    lab = save(reps.join(joined, reps["id"] == joined["node"], "left").select("id", "n", F.coalesce("component", "id").alias("comp")), "labelled")
    sigs = with_set.select("id", "n", "sigs").join(lab, ["id", "n"]).select("id", "comp", F.explode("sigs").alias("sig"))
    members = members_met = save(_meetings(sigs), "members")
    # a document has as many signatures as its length gives
    wide = members.where(F.col("rows") > WIDE).groupBy("id").agg(F.collect_set("sig").alias("wide"))
    large = members.where(F.col("rows") > TILE)
    most = large.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.first("rows").alias("rows"))
    most = save(most.groupBy("sig").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("main_rows"), F.first("rows").alias("all_rows")), "largest")
    large = join_groups(large, most, ["sig"], "all_rows")
    large = meetings_of_tiles(large, F.col("id"), F.col("comp") != F.col("main"), F.col("rows") - F.col("main_rows"), F.col("main_rows"), TILE)
    small = members.where(F.col("rows") <= TILE).select("*", *(F.lit(0).alias(c) for c in ("tile", "i", "j")))
    tiles = small.unionByName(large.select(small.columns)).withColumn("is_wide", F.col("rows") > WIDE)
    points_of = with_set.select("id", "n", "counts").join(wide, "id", "left")
    tiles = tiles.join(points_of, "id").withColumn("wide", F.when(F.col("is_wide"), F.col("wide")))
    pairs = save(_candidates(tiles, sizes), "pairs")
    drop(sketch, members_met, most, lab)
    more = save(_verified_pairs(pairs, docs, n, sizes), "more")
    drop(pairs)

    # an id with several sets joins their classes; copies are no nodes
    several = named.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last"), F.count("*").alias("rows")).where("a <> last")
    several = join_groups(named.select("id", "rep"), save(several, "several"), ["id"], "rows").select("a", F.col("rep").alias("b"))
    components = connected_components(edges.union(more).union(several))
    found = classes.groupBy("rep").agg(F.sum("copies").alias("copies")).join(components, F.col("rep") == F.col("node"), "left")
    found = save(found.select("rep", "copies", F.coalesce("component", "rep").alias("component_id")), "components")
    drop(edges, more, classes)
    out = join_groups(named, found, ["rep"], "copies").select("id", F.col("n").alias("n_shingles"), "component_id")
    # rows without words belong to the component of the other rows with their id
    others = out.select(F.col("id").alias("other"), "component_id").distinct()
    empty = empty.join(others, empty["id"] == others["other"], "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.unionByName(empty)
