"""SimHash near-dedup: fingerprints, links within a Hamming radius found in BK-trees, classes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import map_texts
from ledgerlens.llm.graph import components
from ledgerlens.sources.storage import cut_lineage

SEED = 42
SHARD_ROWS = 4096  # fingerprints that one tree may hold
FOREST_ROWS = 200_000  # fingerprints whose trees are grown together
FRONTIER = 1_000_000  # pairs of query and node that are looked at together
LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed integer; 0 without words."""
    w = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) > words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    ones = np.zeros((8, 8), np.int64)
    full = len(h) - len(h) % 255
    for s in range(8):  # eight bits in the bytes of one word; 255 of them fit without carry
        lanes = (h >> np.uint64(s)) & LANES
        sums = lanes[:full].reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        sums = np.append(sums, lanes[full:].sum(dtype=np.uint64))
        ones[:, s] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (ones.reshape(-1) * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` for each row; null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return map_texts(rows, work, "doc_id long, text_hash long, fp long")


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; labels are the smallest index of a class."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


class Forest:
    """BK-trees, one for each shard, grown and searched together in arrays.

    The first fingerprint of a shard is its root; the others descend along the edge labelled with
    their distance to each node they meet, until there is no such edge, and become a child there.
    ``values`` holds 64-bit fingerprints, or rows of several such words for wider ones.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray) -> None:
        n = len(values)
        self.values = values
        self.bits = 64 * (values.shape[1] if values.ndim > 1 else 1)
        first = np.r_[True, shard[1:] != shard[:-1]]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        edge = np.full(n, -1, np.int64)  # parent * (bits + 1) + distance
        active, at = np.flatnonzero(~first), self.root[~first]
        while len(active):
            key = at * (self.bits + 1) + self.distance(active, at)
            kinds, lead, back = np.unique(key, return_index=True, return_inverse=True)
            edge[active[lead]] = kinds
            stays = np.ones(len(active), bool)
            stays[lead] = False
            at = active[lead][back][stays]
            active = active[stays]
        self.children = np.argsort(edge, kind="stable")
        self.edges = edge[self.children]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(self.values[a] ^ self.values[b])
        return d.sum(axis=1, dtype=np.int64) if d.ndim > 1 else d.astype(np.int64)

    def parts(self, queries: np.ndarray, frontier: int = FRONTIER) -> list[np.ndarray]:
        """Cut queries so that those of one part meet at most about ``frontier`` nodes together."""
        sizes = np.bincount(self.root, minlength=len(self.values))[self.root[queries]]
        return np.split(queries, np.flatnonzero(np.diff(np.cumsum(sizes) // frontier)) + 1)

    def pairs(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, over edges whose label lies within it as well."""
        q, node = queries, self.root[queries]
        while len(q):
            d = self.distance(q, node)
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.edges, node * (self.bits + 1) + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.edges, node * (self.bits + 1) + np.minimum(d + radius, self.bits), "right")
            n = hi - lo
            q = np.repeat(q, n)
            node = self.children[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def classes(self, radius: int) -> np.ndarray:
        """For each fingerprint the first one of its shard it is linked to, directly or not."""
        label = np.arange(len(self.values))
        for part in self.parts(label.copy()):
            for a, b in self.pairs(part, radius):
                label = union(label, a, b)
        return label


def _masks(radius: int) -> list[int]:
    """Masks of two of ``radius + 2`` blocks: fingerprints within the radius agree on one at least."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [(1 << int(b)) - (1 << int(a)) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _finer(mask: int, radius: int) -> list[int]:
    """Masks that add one of ``radius + 1`` blocks of the other bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in part) for part in np.array_split(free, radius + 1) if len(part)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _search(batches: Iterator[pa.RecordBatch], radius: int, shard_rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``mask, value, fp, n`` ordered by shard; yields links, and rows of shards too large."""

    def out(a: np.ndarray, b: np.ndarray, large: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), large))], ["a", "b", "large"]
        )

    def grown(rows: np.ndarray) -> pa.RecordBatch:
        shard = np.cumsum(np.r_[False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        values = np.ascontiguousarray(rows[:, 2])
        label = Forest(values.view(np.uint64), shard).classes(radius)
        linked = label != np.arange(len(label))
        return out(values[linked], values[label[linked]], False)

    waiting = np.empty((0, 3), np.int64)
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        over = rows[:, 3] > shard_rows
        if over.any():
            yield out(rows[over, 0], rows[over, 2], True)
        waiting = np.concatenate([waiting, rows[~over, :3]])
        if len(waiting) >= FOREST_ROWS:
            cut = len(waiting) - np.argmax((waiting[::-1, :2] != waiting[-1, :2]).any(axis=1))
            yield grown(waiting[:cut])
            waiting = waiting[cut:]
    if len(waiting):
        yield grown(waiting)


def link_fingerprints(fps: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``a, b`` that join every class of distinct fingerprints (column ``fp``).

    Shards hold the fingerprints that agree on two of ``radius + 2`` blocks; any two within the
    radius meet in a shard. A shard is searched in its own BK-tree in the task that holds it, and
    yields one link less than a class has members at most. Shards over ``shard_rows`` are split by
    further blocks until they fit: agreement on one of ``radius + 1`` blocks of the bits left is
    as certain. Trees are not sent to all tasks, as nothing bounds their size together.
    """
    spark = fps.sparkSession
    masks = _masks(radius)
    rows = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    found = []
    while True:
        rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        shard = Window.partitionBy("mask", "value")
        counted = rows.withColumn("n", F.count("*").over(shard)).where("n > 1")
        done = cut_lineage(
            counted.mapInArrow(lambda batches: _search(batches, radius, shard_rows), "a long, b long, large boolean")
        )
        found.append(done.where("not large").select("a", "b"))
        large = done.where("large")
        if large.isEmpty():
            break
        finer = {m: _finer(m, radius) for m in masks}
        masks = sorted({x for parts in finer.values() for x in parts})
        # four times as many masks as before; bits run out after a few rounds
        step = spark.createDataFrame([(_signed(m), _signed(x)) for m, xs in finer.items() for x in xs], "a long, mask long")
        rows = large.select("a", F.col("b").alias("fp")).join(F.broadcast(step), "a").select("mask", "fp").distinct()
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 3,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, ``text_hash``.

    Words are split at ASCII white space, A-Z lower-cased. Documents whose fingerprints differ in
    at most ``radius`` bits are linked; ``component_id`` is the smallest doc_id reachable. Equal
    fingerprints are merged before the search, so copies cost nothing there.

    Null or empty text has fingerprint zero and is linked like any other. Null ids get the class
    of their fingerprint (null if it has no other id). Repeated rows fall in one class. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, words))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_fingerprints(fps.select("fp"), radius, shard_rows))
    linked = cut_lineage(
        fps.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
    )
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash"
    )


def smallest_of_class(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` that ``classes`` (doc_id, text_hash, component_id) doesn't give to a smaller
    id. Rows under one id go together; rows without id are told apart by their text."""

    def text_key(doc_id: Column, text_hash: Column) -> Column:
        return F.when(doc_id.isNull(), text_hash).otherwise(F.lit(0))

    gone = classes.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__gone"), text_key(F.col("doc_id"), F.col("text_hash")).alias("__text")
    )
    doc_id = docs[id_col].cast("long")
    same = doc_id.eqNullSafe(F.col("__gone")) & (text_key(doc_id, F.xxhash64(docs[text_col])) == F.col("__text"))
    return docs.join(gone.distinct(), same, "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class of near-duplicates, with all their
    columns. Rows under one id are one document. Rows without id stay if their class has no id."""
    return smallest_of_class(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)
