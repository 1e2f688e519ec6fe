"""Vector code compression: product codes trained with norm-of-sum bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import small_batches
from ledgerlens.sources.storage import scratch_path

GROUPS = 4  # lower bounds kept for each part of a vector
SCALE = 256
LARGEST = 2**28  # of a scaled component, so that squared distances are whole 64-bit numbers
STEP = 4096  # vectors that one vectorised step works on
# Totals of at most this many labels are handed to every task.
SMALL_LABELS = 100_000


def finite(vector: Column) -> Column:
    """Neither the vector nor any component is null, infinite or not a number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as bytes."""
    raw = np.ascontiguousarray(rows)
    width = raw.dtype.itemsize * int(np.prod(raw.shape[1:]))
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def _matrix(column: pa.Array, dtype: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, *shape)


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """Scaled whole components of a column of vectors."""
    values = np.floor(np.asarray(column.flatten(), dtype=np.float64) * SCALE)
    if len(values) != len(column) * width:
        raise ValueError(f"all vectors need {width} components")
    if np.abs(values, out=values.copy()).max(initial=0) >= LARGEST:
        raise ValueError(f"components have to stay below {LARGEST // SCALE}")
    return values.astype(np.int64).reshape(-1, width)


def _down(x: np.ndarray) -> np.ndarray:
    """The nearest half-precision number that is not above ``x``."""
    top = np.float16(np.finfo(np.float16).max)
    half = np.minimum(x, float(top)).astype(np.float16)
    return np.where(half.astype(np.float64) > x, np.nextafter(half, np.float16(-1)), half)


class Bounds:
    """Codes of vector parts under the newest of ``books``, each of shape (part, entry, component).

    For each part and group of entries a vector keeps a lower bound of the distance from that part
    to every entry of the group but its own, stamped with the round whose codebook it was measured
    against. Since then an entry is displaced by the norm of the *sum* of its moves, the distance
    between its place in that codebook and in the newest: never more than its moves one by one. If
    bound minus the largest such displacement of the group stays above the exact distance to the
    part's own entry, no entry of the group can be as near; else the group is measured again and
    stamped anew. Distances are whole numbers, ties go to the lower entry.
    """

    def __init__(self, books: list[np.ndarray], groups: int):
        self.books, self.now = books, books[-1]
        self.parts, self.entries, self.width = self.now.shape
        self.members = [g for g in np.array_split(np.arange(self.entries), groups) if len(g)]
        self.group_of = np.concatenate([np.full(len(g), i) for i, g in enumerate(self.members)])
        # largest net displacement in a group without entry a, by (stamp, part, group, a)
        self.net = np.zeros((len(books), self.parts, len(self.members), self.entries))
        for stamp, book in enumerate(books):
            moved = np.sqrt(np.square(self.now - book).sum(axis=2).astype(np.float64))
            for g, members in enumerate(self.members):
                high = np.sort(moved[:, members], axis=1)
                self.net[stamp, :, g, :] = high[:, -1:]
                for a in members:
                    rest = moved[:, members[members != a]]
                    self.net[stamp, :, g, a] = rest.max(axis=1) if rest.size else 0

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, bounds and stamps of vectors that nothing is known of: every group is measured."""
        shape = (n, self.parts, len(self.members))
        return np.zeros(shape[:2], np.uint8), np.full(shape, -1, np.float16), np.zeros(shape, np.uint8)

    def assign(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray):
        """New codes, their squared distances, bounds and stamps of ``x`` (vector, part, component)."""
        code, bound, stamp = code.copy(), bound.copy(), stamp.copy()
        squared = np.empty(code.shape, np.int64)
        for p in range(self.parts):
            own = code[:, p].astype(np.int64)
            best = np.square(x[:, p] - self.now[p, own]).sum(axis=1)
            near = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-9
            left = np.empty(bound[:, p].shape)
            for g in range(len(self.members)):
                left[:, g] = bound[:, p, g].astype(np.float64) - self.net[stamp[:, p, g], p, g, own]
            again = ~(near[:, None] < left)
            # an own entry that may change has to count in the bound of its group
            some = again.any(axis=1)
            again[some, self.group_of[own[some]]] = True
            found = {}
            new, least = own.copy(), best.copy()
            least[some] = np.iinfo(np.int64).max
            for g, members in enumerate(self.members):
                rows = np.flatnonzero(again[:, g])
                if not len(rows):
                    continue
                d = np.square(x[rows, p][:, None, :] - self.now[p, members][None]).sum(axis=2)
                at = d.argmin(axis=1)
                low = d[np.arange(len(rows)), at]
                better = low < least[rows]  # groups come in the order of their entries
                least[rows[better]], new[rows[better]] = low[better], members[at[better]]
                found[g] = rows, d
            for g, (rows, d) in found.items():
                mine = self.group_of[new[rows]] == g
                d = d.astype(np.float64)
                d[np.flatnonzero(mine), new[rows[mine]] - self.members[g][0]] = np.inf
                bound[rows, p, g] = _down(np.sqrt(d.min(axis=1)))
                stamp[rows, p, g] = len(self.books) - 1
            code[:, p], squared[:, p] = new, least
        return code, squared, bound, stamp


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _round(rows: DataFrame, books: list[np.ndarray], groups: int, types: tuple[str, str]) -> DataFrame:
    """State of every vector under the newest codebooks, and one row of sums from each task."""
    parts, entries, width = books[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Bounds(books, groups)
        shape = (parts, len(work.members))
        sums = np.zeros((parts, entries, width + 1), np.int64)
        schema = None
        for batch in _steps(batches):
            ids, labels, given, *state = batch.columns
            x = _whole(given, parts * width) if not state else np.asarray(given.flatten(), dtype=np.int64).reshape(-1, parts * width)
            cut = x.reshape(-1, parts, width)
            if state:
                before = _matrix(state[0], np.uint8, shape[:1]), _matrix(state[1], np.float16, shape), _matrix(state[2], np.uint8, shape)
            else:
                before = work.start(len(x))
            code, squared, bound, stamp = work.assign(cut, *before)
            for p in range(parts):
                sums[p, :, width] += np.bincount(code[:, p], minlength=entries)
                for c in range(width):
                    # exact: halves below 2^53
                    sums[p, :, c] += np.rint(np.bincount(code[:, p], weights=cut[:, p, c], minlength=entries)).astype(np.int64)
            n = len(x)
            ints = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts * width), pa.array(x.ravel().astype(np.int32)))
            out = [ids, labels, ints, _binary(code), _binary(bound), _binary(stamp), pa.array(squared.sum(axis=1)), pa.nulls(n, pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(out, NAMES)
            schema = out.schema
            yield out
        if schema is not None:
            row = [pa.nulls(1, f.type) for f in schema][:-1] + [pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(row, NAMES)

    kinds = (*types, "array<int>", "binary", "binary", "binary", "bigint", "array<bigint>")
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds)))


NAMES = ["id", "label", "ints", "code", "bound", "stamp", "error", "sums"]


def _moved(book: np.ndarray, state: DataFrame) -> np.ndarray:
    """Entries at the floor of the mean of their parts; unused entries stay."""
    parts, entries, width = book.shape
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    cells = state.where("sums is not null").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    for at, n in cells.collect():  # one number for each component of a codebook
        flat[at] = n
    sums = flat.reshape(parts, entries, width + 1)
    count = sums[:, :, width:]
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), book)


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    groups: int = GROUPS,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (part, entry, component) they refer to.

    Columns: ``id``, ``label``, ``code`` (hex, two digits for each part) and ``error`` (squared
    distance over all parts). Components are floors of 256 times the given ones. Codebooks start as
    the parts of the vectors with the smallest ids (ties by vector, null ids last) and move
    ``rounds`` times to the floored mean of what is assigned to them; see ``Bounds`` for how a round
    spares measuring. Between rounds the state of each vector (codes, bounds, stamps) is a written
    table; a task hands on one sum for each entry and component, and Spark adds those up, so nothing
    that grows with the vectors meets in one place, however many of them are equal.

    Vectors that are null or hold a null or non-finite component are left out. Repeated ids and rows
    are each coded. Fewer vectors than ``entries`` give fewer entries, an empty table an empty result
    and no entries. Vectors of different lengths, a length that ``parts`` does not divide, and
    components from 2^20 on raise an error. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    spark = vectors.sparkSession
    kept = vectors.where(finite(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    types = tuple(kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    seeds = [r.v for r in kept.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    if not seeds:
        empty = spark.createDataFrame([], f"id {types[0]}, label {types[1]}, code string, error bigint")
        return empty, np.zeros((parts, 0, 0), np.int64)
    width, odd = divmod(len(seeds[0]), parts)
    if odd:
        raise ValueError(f"{len(seeds[0])} components do not make {parts} equal parts")
    first = _whole(pa.array(seeds, pa.list_(pa.float64())), parts * width)
    books = [first.reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()]
    rows = kept
    for i in range(rounds):
        path = scratch_path(spark, f"codes-{i}")
        _round(rows, books, groups, types).write.parquet(path)
        state = spark.read.parquet(path)
        books.append(_moved(books[-1], state))
        rows = state.where("sums is null").select(*NAMES[:6])
    last = _round(rows, books, groups, types).where("sums is null")
    return last.select("id", "label", F.lower(F.hex("code")).alias("code"), "error"), books[-1]


def codebook_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(n) for n in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of the same label added up, null labels together.

    Totals are partial sums by label. They go to every task while there are at most ``SMALL_LABELS``
    of them (counted); beyond, rows meet them in a join, where adaptive execution splits a hot label.
    """
    totals = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    if totals.count() <= SMALL_LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
