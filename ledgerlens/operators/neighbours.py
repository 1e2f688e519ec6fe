"""Exact nearest neighbour transfer of a label between two tables.

Both sides are standardised by their own statistics and paired by two feature lists of
equal length. Identical labelled vectors are merged first. The labelled side becomes a tree:
a crowded cell is cut around pivots of its own, level by level, until cells hold a bounded
number of vectors. A query first goes down to the nearest cell, which gives it a bound, and
then visits only the cells that can hold a vector within that bound, by their pivots and by the
box around their members. The box tells cells apart also for queries far from all labelled
vectors, to whom all pivots are about equally far. Cells are as large as a task can hold, so that
a query meets few of them; within a cell a tree of small boxes spares most vectors. One path serves
every size: neither side nor the pivots are collected or broadcast, and a task holds one cell and
one block of queries. Results are exact on any data; how much the bounds spare depends on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.vectors import vector_of
from ledgerlens.operators.boxes import BoxTree
from ledgerlens.operators.similarity import fit_scaler, standardize
from ledgerlens.operators.skew import bounded_broadcast
from ledgerlens.sources.storage import cut_lineage

CELL_ROWS = 300_000  # labelled vectors of a cell
BLOCK_ROWS = 20_000  # rows that meet the pivots of one cell in a task
LEAF_BLOCKS = 10  # times as many meet one cell, as each block of them gets a copy of the cell
FANOUT = 64  # pivots of a crowded cell at most
# Cells that so many levels could not thin out (nearly equal vectors) are cut by a hash instead.
MAX_LEVELS = 9
_STEP_ELEMENTS = 4_000_000
_ROOT = 0


@dataclass(frozen=True)
class PivotTree:
    """``levels`` hold the children of crowded cells: parent, node, pivot, least and greatest
    distance of a member from the pivot (low, high), the box around the members (least, most),
    vectors (n), parts of a leaf (0 for an inner cell). ``leaves`` are the labelled rows with the cell and part they lie in."""

    levels: list[DataFrame]
    leaves: DataFrame
    root_parts: int
    width: int


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), width)


def _flat(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _nearest(q: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, squared distance) of the nearest point; the first one wins a tie.

    A matrix product finds the candidates within its rounding error, and only those are
    measured position by position.
    """
    where = np.empty(len(q), dtype=np.int64)
    dist = np.empty(len(q))
    sizes = np.square(points).sum(axis=1)
    slack = 1e-10 * (sizes.max() + np.square(q).sum(axis=1) + 1)
    step = max(1, _STEP_ELEMENTS // len(points))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        rough = sizes[None, :] - 2 * (part @ points.T)
        bound = rough.min(axis=1) + slack[i : i + step]
        row, col = np.nonzero(rough <= bound[:, None])
        exact = np.square(part[row] - points[col]).sum(axis=1)
        order = np.lexsort((col, exact, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        where[i : i + step] = col[first]
        dist[i : i + step] = exact[first]
    return where, dist


def _gaps(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to all pivots, position by position so that nothing cancels."""
    out = np.zeros((len(q), len(pivots)))
    for d in range(q.shape[1]):
        out += np.square(q[:, d, None] - pivots[None, :, d])
    return np.sqrt(out)


def _outside(q: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Distances to boxes, 0 inside of them."""
    out = np.zeros((len(q), len(least)))
    for d in range(q.shape[1]):
        at = q[:, d, None]
        out += np.square(np.fmax(np.fmax(least[None, :, d] - at, at - most[None, :, d]), 0))
    return np.sqrt(out)


def _distinct_points(labelled: DataFrame) -> DataFrame:
    """One row per distinct vector: the smallest id and its label."""
    return labelled.groupBy("v").agg(
        F.min_by(F.struct("nid", "label"), "nid").alias("p")
    ).select("v", "p.nid", "p.label")


def _afresh(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, as both sides may stem from one frame."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _meet(
    many: DataFrame, row_id: str, few: DataFrame, keys: Sequence[str], block_rows: int, work, schema: str,
    *, arrow: bool = False,
) -> DataFrame:
    """``work(rows of many, rows of few)`` for equal keys, as pandas frames or Arrow tables.

    The rows of ``many`` are dealt over blocks of about ``block_rows``, also where one key holds
    most of them, and the bounded rows of ``few`` are repeated for each block. ``many`` is read
    twice, so it has to be cheap: stored rows, filtered or joined to a few.
    """
    blocks = many.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks")
    )
    blocks = bounded_broadcast(_afresh(blocks))
    left = many.join(blocks, list(keys)).withColumn(
        "_block", F.pmod(F.xxhash64(row_id), F.col("_blocks")).cast("int")
    )
    right = few.join(blocks, list(keys)).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    )
    by = [*keys, "_block"]
    both = left.drop("_blocks").groupBy(*by).cogroup(_afresh(right.drop("_blocks")).groupBy(*by))
    return both.applyInArrow(work, schema) if arrow else both.applyInPandas(work, schema)


def build_tree(
    points: DataFrame, width: int, *, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
    fanout: int = FANOUT,
) -> PivotTree:
    """Cut ``points`` (v, nid, label; distinct vectors) into cells of at most ``cell_rows``.

    Each crowded cell takes as pivots the members with the least hash in some classes of a hash, which
    combines before the shuffle, and each member joins its nearest pivot. There are as many classes
    as the most crowded cell needs, ``fanout`` at most. All crowded cells of a level are cut at once.
    """

    def assign(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # no row was dealt to this block
            return pd.DataFrame({c: [] for c in ("v", "nid", "label", "parent", "node", "away")}, dtype=object)
        pivots = pivots.sort_values("child", ignore_index=True)
        where, dist = _nearest(_matrix(rows["v"], width), _matrix(pivots["pivot"], width))
        return pd.DataFrame(
            {
                "v": rows["v"], "nid": rows["nid"], "label": rows["label"].astype(object),
                "parent": rows["node"], "node": pivots["child"].to_numpy()[where],
                "away": np.sqrt(dist),
            }
        )

    def parts_of(n: Column, last: bool) -> Column:
        parts = F.ceil(n / F.lit(cell_rows)).cast("int")
        return parts if last else F.when(n <= cell_rows, 1).otherwise(0)

    if fanout < 2 or fanout**MAX_LEVELS >= 2**62:
        raise ValueError("fanout has to be 2 to 100")
    order = F.xxhash64("nid")
    levels, leaves = [], []
    rows = points.count()
    crowded = points.select("v", "nid", "label", F.lit(_ROOT).cast("long").alias("node"))
    if rows <= cell_rows:
        return PivotTree([], crowded.withColumn("part", F.lit(0)), min(rows, 1), width)
    most = rows
    for level in range(1, MAX_LEVELS + 1):
        kind = F.pmod(order, F.lit(max(2, min(fanout, ceil(2 * most / cell_rows)))))
        pivots = crowded.groupBy("node", kind.alias("kind")).agg(
            F.min_by("v", F.struct(order, F.col("nid"))).alias("pivot")
        )
        pivots = cut_lineage(
            pivots.select("node", (F.col("node") * fanout + 1 + F.col("kind")).alias("child"), "pivot")
        )
        placed = cut_lineage(
            _meet(
                crowded, "nid", pivots, ["node"], block_rows, assign,
                "v array<double>, nid long, label string, parent long, node long, away double",
            )
        )
        cells = placed.groupBy("parent", "node").agg(
            F.min("away").alias("low"), F.max("away").alias("high"), F.count(F.lit(1)).alias("n"),
            F.array(*[F.min(F.col("v")[i]) for i in range(width)]).alias("least"),
            F.array(*[F.max(F.col("v")[i]) for i in range(width)]).alias("most"),
        )
        cells = cells.withColumn("parts", parts_of(F.col("n"), level == MAX_LEVELS)).join(
            pivots.select(F.col("child").alias("node"), "pivot"), "node"
        )
        cells = cut_lineage(cells)
        levels.append(cells)
        marked = placed.join(bounded_broadcast(cells.select("node", "parts")), "node")
        part = F.pmod(F.xxhash64("nid", F.lit(1)), F.col("parts")).cast("int")
        leaves.append(
            marked.where("parts > 0").select("v", "nid", "label", "node", part.alias("part"))
        )
        most = cells.where("parts = 0").agg(F.max("n")).first()[0]
        if most is None:
            break
        crowded = marked.where("parts = 0").select("v", "nid", "label", "node")
    return PivotTree(levels, reduce(DataFrame.unionByName, leaves), 0, width)


def _visits(queries: DataFrame, tree: PivotTree, block_rows: int, *, bounded: bool) -> DataFrame:
    """Rows (qid, v, node, part, and best if ``bounded``) of the leaves to visit: the nearest one on the way down, or
    with ``bounded`` every one that can hold a vector within ``best``, but for ``home``.

    A member x of a cell lies between ``low`` and ``high`` from its pivot, no nearer to the pivot of
    a sister cell and inside the box of the cell, so |q - x| <= best leaves three tests on the
    distances of the pivots and one on that of the box.
    """
    width = tree.width

    def step(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("node", ignore_index=True)
        q = _matrix(rows["v"], width)
        box = _outside(q, _matrix(cells["least"], width), _matrix(cells["most"], width))
        gap = _gaps(q, _matrix(cells["pivot"], width))
        if bounded:
            low, high = cells["low"].to_numpy()[None, :], cells["high"].to_numpy()[None, :]
            reach = rows["best"].to_numpy()[:, None]
            reach = reach + 1e-9 * (1 + reach + gap + high)
            keep = (gap - high <= reach) & (low - gap <= reach)
            keep &= (gap - gap.min(axis=1, keepdims=True) <= 2 * reach) & (box <= reach)
            row, col = np.nonzero(keep)
        else:
            # the nearest box; of several that hold the query, the one with the nearest pivot
            near = np.where(box <= box.min(axis=1, keepdims=True), gap, np.inf)
            row, col = np.arange(len(rows)), near.argmin(axis=1)
        out = rows.iloc[row].drop(columns="_block").reset_index(drop=True)
        out["node"] = cells["node"].to_numpy()[col]
        out["parts"] = cells["parts"].to_numpy()[col]
        return out

    keep = ["qid", "v", "best", "home"] if bounded else ["qid", "v"]
    schema = "qid long, v array<double>, node long, parts int"
    schema += ", best double, home long" if bounded else ""
    front = queries.select(*keep, F.lit(_ROOT).cast("long").alias("node"))
    found = [front.withColumn("parts", F.lit(tree.root_parts)).where("parts > 0")]
    for cells in tree.levels:
        children = cells.select(
            F.col("parent"), F.col("node").alias("child"), "pivot", "low", "high", "least", "most", "parts"
        ).withColumnsRenamed({"parent": "node", "child": "node_"})

        def at(rows: pd.DataFrame, few: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:  # no row was dealt to this block
                return pd.DataFrame({c: [] for c in [*keep, "node", "parts"]}, dtype=object)
            return step(rows, few.drop(columns=["node"]).rename(columns={"node_": "node"}))

        moved = cut_lineage(_meet(front, "qid", children, ["node"], block_rows, at, schema))
        found.append(moved.where("parts > 0"))
        front = moved.where("parts = 0").select(*keep, "node")
    visits = reduce(DataFrame.unionByName, [f.select(*keep, "node", "parts") for f in found])
    if bounded:
        visits = visits.where(F.col("node") != F.col("home"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    return visits.select(*keep[:3], "node", part)


def search_tree(queries: DataFrame, tree: PivotTree, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest labelled row of each query (qid, v): qid, nid, label, distance and ``compared``,
    the number of labelled vectors it was compared with. Equal distances go to the smaller id."""
    width = tree.width
    schema = "qid long, node long, nid long, label string, d2 double, n long"

    def search(rows: pa.Table, cell: pa.Table) -> pa.Table:
        where = dist = seen = np.empty(0)
        if rows.num_rows and cell.num_rows:  # else no query was dealt to this block
            cell = cell.take(np.argsort(cell["nid"].fill_null(np.iinfo(np.int64).max).to_numpy(), kind="stable"))
            bound = None
            if "best" in rows.column_names:
                best = rows["best"].to_numpy()
                bound = np.square(best + 1e-9 * (1 + best))
            where, dist, seen = BoxTree(_flat(cell["v"], width)).nearest(_flat(rows["v"], width), bound)
        met = np.flatnonzero(seen > 0)
        # -1: the vectors compared lie beyond the bound
        where, found = where[met], pa.array(where[met] >= 0)
        at = pa.compute.if_else(found, pa.array(where, pa.int64()), None)
        return pa.table(
            {
                "qid": rows["qid"].take(met), "node": rows["node"].take(met), "nid": cell["nid"].take(at),
                "label": cell["label"].take(at), "d2": pa.array(dist[met]), "n": pa.array(seen[met], pa.int64()),
            }
        )

    def look_up(visits: DataFrame) -> DataFrame:
        return _meet(
            visits, "qid", tree.leaves, ["node", "part"], LEAF_BLOCKS * block_rows, search, schema, arrow=True
        )

    def best_of(candidates: DataFrame) -> DataFrame:
        return candidates.groupBy("qid").agg(
            F.min_by(F.struct("nid", "label", "d2", "node"), F.struct("d2", "nid")).alias("b"),
            F.sum("n").alias("n"),
        ).select("qid", "b.*", "n")

    best = best_of(look_up(_visits(queries, tree, block_rows, bounded=False)))
    if tree.levels:
        home = cut_lineage(best)
        known = queries.join(
            home.select("qid", F.sqrt("d2").alias("best"), F.col("node").alias("home")), "qid"
        )
        others = look_up(_visits(cut_lineage(known), tree, block_rows, bounded=True))
        best = best_of(home.unionByName(others))
    return best.select(
        "qid", "nid", "label", F.sqrt("d2").alias("distance"), F.col("n").alias("compared")
    )


def nearest_label(
    queries: DataFrame,
    labelled: DataFrame,
    *,
    query_id: str,
    labelled_id: str,
    label: str,
    pairs: Sequence[tuple[str, str]],
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    fanout: int = FANOUT,
) -> DataFrame:
    """For each query row the nearest labelled row by Euclidean distance after scaling.

    ``pairs`` lists (query feature, labelled feature); missing values are 0. Equal
    distances go to the smaller id. Returns qid, nid, label, distance, compared; no rows
    without labelled rows. Query ids are taken as distinct; rows without id get no result.
    """
    width = len(pairs)
    q = queries.select(
        F.col(query_id).cast("long").alias("qid"), vector_of(queries, [a for a, _ in pairs]).alias("v")
    )
    p = labelled.select(
        F.col(labelled_id).cast("long").alias("nid"),
        F.col(label).alias("label"),
        vector_of(labelled, [b for _, b in pairs]).alias("v"),
    )
    # The query side may be a long plan; written once, it serves the scaler and the search.
    q = cut_lineage(q)
    q = standardize(q, "v", fit_scaler([q], "v", width), width).where("qid is not null")
    points = _distinct_points(standardize(p, "v", fit_scaler([p], "v", width), width))
    tree = build_tree(
        cut_lineage(points), width, cell_rows=cell_rows, block_rows=block_rows, fanout=fanout
    )
    return search_tree(cut_lineage(q.select("qid", "v")), tree, block_rows=block_rows)
