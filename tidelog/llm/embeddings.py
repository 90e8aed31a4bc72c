"""Near duplicates among embeddings: a subspace pigeonhole join, verified exactly."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, drop, join_groups, meetings_of_tiles, save, ship

MIN_COSINE = 0.93
#: Low-dimensional blocks that the rotated vectors are split into.
BLOCKS = 4
#: Different vectors in a tile; a task compares two tiles.
TILE = 1024
#: Coordinates of a block by which a label's space may be cut, each at its quartiles: at most 4 ** CUTS cells a block.
CUTS = 6
#: All of a vector's blocks are searched at once (labels that are not cut).
ALL_BLOCKS = -1
#: A label is cut if the pairs that then meet in the cells of all its blocks are at most this many times all its pairs.
CUT_SHARE = 1.0
#: Pairs that are verified at a time, and vectors that are placed at a time.
PAIRS = 8192
PLACED = 512
_QUARTILES = (0.25, 0.5, 0.75)


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation, which spreads any pair's distance over all blocks."""
    return np.linalg.qr(np.random.default_rng(17).standard_normal((dim, dim)))[0]


def block_edges(dim: int) -> list[tuple[int, int]]:
    """First and last coordinate (exclusive) of each block."""
    parts = [k for k in np.array_split(np.arange(dim), min(BLOCKS, dim))]
    return [(int(p[0]), int(p[-1]) + 1) for p in parts]


def budget(dim: int, min_cosine: float) -> float:
    """Unit vectors with this cosine have a squared distance of 2 - 2 min_cosine at most, so that one block at least keeps its
    proportional share of it; with room for rounding."""
    return max(0.0, 2 - 2 * min_cosine) / len(block_edges(dim)) * (1 + 1e-9) + 1e-9


def depth(rows: int, tile: int) -> int:
    """Coordinates of each block by which a label of so many vectors is cut: none if they are one tile."""
    return 0 if rows <= tile else min(CUTS, math.ceil(math.log(rows / tile, 4)))


def _rotated(batches):
    """Each vector scaled by a power of two, which is exact, its unit vector rotated, and the coordinates of each block that may be cut (NaN where
    a block has fewer)."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            part = batch.take(pa.array(np.flatnonzero(dims == dim)))
            v = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
            x = (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ rotation(dim)
            lead = np.full((len(x), BLOCKS * CUTS), np.nan)
            for b, (first, last) in enumerate(block_edges(dim)):
                n = min(CUTS, last - first)
                lead[:, b * CUTS : b * CUTS + n] = x[:, first : first + n]
            columns = {c: part.column(c) for c in ("h1", "h2", "node", "copies", "dim", "label")} | {"vec": _lists(v), "rot": _lists(x), "lead": _lists(lead)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def cells_of(x: np.ndarray, cuts: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each point x, and the pairs (point, other cell) with a squared distance of at most `most`. cuts: for each
    coordinate the values at which it is cut; cells are numbered by slabs, the first coordinate's last."""
    slab = (x[:, :, None] >= cuts[None, :, :]).sum(axis=2)
    low = np.hstack([np.full((len(cuts), 1), -np.inf), cuts])
    high = np.hstack([cuts, np.full((len(cuts), 1), np.inf)])
    gap = np.maximum(0, np.maximum(low[None, :, :] - x[:, :, None], x[:, :, None] - high[None, :, :])) ** 2
    home, far = np.zeros(len(x), np.int64), np.zeros((len(x), 1))
    for c in range(len(cuts)):
        home += slab[:, c] * gap.shape[2] ** c
        far = (gap[:, c, :, None] + far[:, None, :]).reshape(len(x), -1)
    far[np.arange(len(x)), home] = np.inf
    return home, *np.nonzero(far <= most)


def _placed(tile: int, min_cosine: float, counted: bool = False):
    """Rows (h1, h2, label, dim, block, cell, own): where a vector is at home in each block, and the cells of higher number that it can reach there.
    A pair of two cells meets in the higher one. With counted, a row (label, dim, block, cell, own_rows, other_rows) for each cell of a batch."""

    def run(batches):
        for batch in batches:
            rows, dims = batch.column("rows").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy(zero_copy_only=False)
            lead, cuts = batch.column("lead").to_pylist(), batch.column("cuts").to_pylist()
            small = np.flatnonzero([c is None for c in cuts])
            at, block, cell, own = [small], [np.full(len(small), ALL_BLOCKS)], [np.zeros(len(small), np.int64)], [np.ones(len(small), bool)]
            groups: dict = {}
            for k in np.setdiff1d(np.arange(len(rows)), small).tolist():
                groups.setdefault((int(dims[k]), int(rows[k]), repr(cuts[k])), []).append(k)
            for (dim, n, _), every in groups.items():
                for members in (np.array(every[k : k + PLACED]) for k in range(0, len(every), PLACED)):
                    for b, (first, last) in enumerate(block_edges(dim)):
                        q = min(depth(n, tile), last - first)
                        x = np.array([lead[k][b * CUTS : b * CUTS + q] for k in members.tolist()], float)
                        home, who, where = cells_of(x, np.array(cuts[members[0]][b * CUTS : b * CUTS + q], float), budget(dim, min_cosine))
                        higher = where > home[who]
                        who, where = who[higher], where[higher]
                        at += [members, members[who]]
                        block.append(np.full(len(members) + len(who), b))
                        cell += [home, where]
                        own += [np.ones(len(members), bool), np.zeros(len(who), bool)]
            at, block, cell, own = (np.concatenate(x) for x in (at, block, cell, own))
            if counted:
                which = [batch.column("label").dictionary_encode(), batch.column("dim")]
                which = np.array([which[0].indices.to_numpy(zero_copy_only=False)[at], dims[at], block, cell], np.int64)
                which, back, n = np.unique(which, axis=1, return_inverse=True, return_counts=True)
                mine = np.bincount(back.ravel(), weights=own, minlength=len(n)).astype(np.int64)
                labels = batch.column("label").dictionary_encode().dictionary.take(pa.array(which[0]))
                columns = [labels, *(pa.array(x.astype(np.int32)) for x in which[1:]), pa.array(mine), pa.array(n.astype(np.int64) - mine)]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "block", "cell", "own_rows", "other_rows"])
                continue
            part = batch.select(["h1", "h2", "label", "dim"]).take(pa.array(at))
            more = [pa.array(block.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=["h1", "h2", "label", "dim", "block", "cell", "own"])

    return run


def linked(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, block: int, min_cosine: float = MIN_COSINE, same: bool = False) -> np.ndarray:
    """Which rows of a and b have a cosine of min_cosine or more, in double precision; x and y are their rotated unit vectors.

    Candidates are the pairs within the budget of the block, or of any block. With one block, pairs that are within the budget of an earlier one are
    left to that: its distances are computed pair by pair, alike in every task. With same, a and b are the same rows
    and each pair is found once, the earlier row in a.
    """
    edges, most = block_edges(x.shape[1]), budget(x.shape[1], min_cosine)
    near = np.zeros((len(a), len(b)), bool)
    for first, last in edges if block == ALL_BLOCKS else [edges[block]]:
        xs, ys = x[:, first:last], y[:, first:last]
        distance = (xs * xs).sum(axis=1)[:, None] + (ys * ys).sum(axis=1)[None, :] - 2 * (xs @ ys.T)
        near |= distance <= most + 1e-9
    if same:
        near = np.triu(near, 1)
    left, right = np.nonzero(near)
    near[:] = False
    for k in range(0, len(left), PAIRS):
        i, j = left[k : k + PAIRS], right[k : k + PAIRS]
        if block != ALL_BLOCKS:
            square = (x[i] - y[j]) ** 2
            within = np.array([square[:, first:last].sum(axis=1) <= most for first, last in edges[: block + 1]])
            first_here = within[block] & ~within[:block].any(axis=0)
            i, j = i[first_here], j[first_here]
        u, v = a[i], b[j]
        cosine = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
        near[i, j] = cosine >= min_cosine
    return near


def _least_reachable(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label that each row and column reaches by links."""
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(left, np.where(link, right[None, :], top).min(axis=1, initial=top))
        back = np.minimum(right, np.where(link, new[:, None], top).min(axis=0, initial=top))
        if (new == left).all() and (back == right).all():
            return left, right
        left, right = new, back


def compare_tiles(part: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """Links of one pair of tiles: for each vector their weighted number, and the smallest node it reaches here."""
    first, second, block = (int(part[c].iloc[0]) for c in ("i", "j", "block"))
    a, b = part[part["tile"] == first], part[part["tile"] == second]
    if not len(a) or not len(b):
        return pd.DataFrame({"h1": [], "h2": [], "node": [], "links": [], "least": []}).astype("int64")
    u, v = (np.stack(t["vec"].to_numpy()) for t in (a, b))
    if block == ALL_BLOCKS:
        x, y = ((w / np.sqrt((w * w).sum(axis=1))[:, None]) @ rotation(w.shape[1]) for w in (u, v))
    else:
        x, y = (np.stack(t["rot"].to_numpy()) for t in (a, b))
    link = linked(u, v, x, y, block, min_cosine, first == second)
    if first == second:
        link |= link.T
    left, right = _least_reachable(link, a["node"].to_numpy(), b["node"].to_numpy())
    out = [pd.DataFrame({"h1": a["h1"], "h2": a["h2"], "node": a["node"], "links": link @ b["copies"].to_numpy(), "least": left})]
    if first != second:
        out.append(pd.DataFrame({"h1": b["h1"], "h2": b["h2"], "node": b["node"], "links": a["copies"].to_numpy() @ link, "least": right}))
    out = pd.concat(out)
    return out[out["links"] > 0].astype("int64")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 min_cosine: float = MIN_COSINE, tile: int = TILE, cut_share: float = CUT_SHARE) -> DataFrame:
    """Rows (id, n_links, component_id, kept) for all rows of vectors; kept is id = component_id.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine is at least min_cosine. Vectors that
    are null, empty or zero or hold null or non-finite numbers link with nothing, nor do rows with a null id (their component is
    null). Repeated rows are vectors of their own with one id. Links to equal vectors count. An empty table gives an empty result.

    Equal vectors are one class with its number of copies (aggregated before the shuffle), so a group of copies of any
    size is one point. In each block a label's space is cut into cells at quartiles of some coordinates, the more of them the more
    vectors it has. A vector visits the cells that lie within the block's budget of it, so that every pair of the block's range join
    meets in one cell. Cells of many vectors are compared tile by tile: a task has two tiles, and returns at most one
    row per vector, not pairs. A pair counts in the first block whose budget it keeps. A label of one tile, or one whose cells would
    bring more pairs together than there are (cut_share), is one cell in which all blocks' budgets are looked at.
    """
    ship(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("vec", F.when(F.coalesce(ok, F.lit(False)), F.transform("vec", lambda x: x + 0.0)))
    # 128 bits stand for label and vector where only equality counts
    v = v.select("id", "label", F.size("vec").alias("dim"), "vec", F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit(1), "label", "vec").alias("h2"))
    able = v.where("vec IS NOT NULL")
    classes = able.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    kind = v.schema["label"].dataType.simpleString()
    classes = classes.mapInArrow(_rotated, f"h1 long, h2 long, node long, copies long, dim int, label {kind}, vec array<double>, rot array<double>, lead array<double>")
    classes = save(classes, "vectors")

    on = ["label", "dim"]
    sizes = save(classes.groupBy(*on).agg(F.count("*").alias("rows")), "labels")
    large = sizes.where(F.col("rows") > tile)
    quartiles = lambda k: F.percentile_approx(F.try_element_at("lead", F.lit(k + 1)), list(_QUARTILES), 100)
    cuts = join_groups(classes.select(*on, "lead"), large, on, "rows").groupBy(*on).agg(F.array(*map(quartiles, range(BLOCKS * CUTS))).alias("cuts"))
    cuts = save(cuts.join(large, on), "cuts")
    cell = [*on, "block", "cell"]

    def placed(grid, counted=False):
        places = join_groups(classes.select("h1", "h2", *on, "lead"), grid, on, "rows")
        out = "own_rows long, other_rows long" if counted else "own boolean"
        return places.mapInArrow(_placed(tile, min_cosine, counted), ("" if counted else "h1 long, h2 long, ") + f"label {kind}, dim int, block int, cell int, {out}")

    # cells only save work where few of them are near a vector, which their numbers of vectors tell
    met = F.expr("own_rows * (own_rows - 1D) / 2 + own_rows * 1D * other_rows")
    work = placed(cuts, counted=True).groupBy(*cell).agg(F.sum("own_rows").alias("own_rows"), F.sum("other_rows").alias("other_rows"))
    work = save(work.groupBy(*on).agg(F.sum(met).alias("met")), "work").join(large, on)
    cut = work.where(f"met <= {cut_share}D * rows * (rows - 1D) / 2")
    grid = save(sizes.join(cuts.drop("rows").join(cut.select(*on), on, "left_semi"), on, "left"), "grid")
    places = save(placed(grid), "places")
    owners = F.sum(F.col("own").cast("long"))
    counts = save(places.groupBy(*cell).agg(owners.alias("own_rows"), (F.count("*") - owners).alias("other_rows"), F.count("*").alias("rows")), "cells")
    t = join_groups(places, counts, cell, "rows")
    t = meetings_of_tiles(t, F.struct("h1", "h2"), F.col("own"), F.col("own_rows"), F.col("other_rows"), tile)
    t = t.join(classes.select("h1", "h2", "node", "copies", "vec", "rot"), ["h1", "h2"]).withColumn("rot", F.when(F.col("block") != ALL_BLOCKS, F.col("rot")))
    found = t.groupBy(*cell, "i", "j").applyInPandas(lambda part: compare_tiles(part, min_cosine), "h1 long, h2 long, node long, links long, least long")
    found = save(found, "vector_links")
    drop(places, counts)
    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    # an id with several vectors joins their classes
    named = save(join_groups(able.select("id", "h1", "h2"), classes.select("h1", "h2", "node", "copies"), ["h1", "h2"], "copies"), "vector_ids")
    several = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("last"), F.count("*").alias("rows")).where("a <> last")
    several = join_groups(named.select("id", "node"), save(several, "several"), ["id"], "rows").select("a", F.col("node").alias("b"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).union(several))
    per_class = classes.select("h1", "h2", "node", "copies").join(links, ["h1", "h2"], "left").join(components, "node", "left")
    per_class = save(per_class.select("h1", "h2", "node", "copies", "links", "component"), "vector_classes")
    out = join_groups(able.drop("vec"), per_class, ["h1", "h2"], "copies")
    out = out.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    # rows that link with nothing belong to the component of the other rows with their id
    rest = v.where("vec IS NULL").select("id")
    others = out.select(F.col("id").alias("other"), "component_id").distinct()
    rest = rest.join(others, rest["id"] == others["other"], "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
