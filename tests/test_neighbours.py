"""The tree search against all pairs."""

import numpy as np
import pytest

from ledgerlens.operators import boxes, neighbours
from ledgerlens.operators.neighbours import build_tree, nearest_label, search_tree


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(5)
    q = [(i, *map(float, rng.normal(size=3))) for i in range(300)]
    p = [(i, f"l{i % 7}", *map(float, rng.normal(size=3))) for i in range(900)]
    # A third of the labelled side is one and the same vector.
    p += [(900 + i, "same", 0.5, 0.5, 0.5) for i in range(450)]
    return (
        spark.createDataFrame(q, "q long, a double, b double, c double"),
        spark.createDataFrame(p, "p long, label string, x double, y double, z double"),
        np.array([r[1:] for r in q]),
        np.array([r[2:] for r in p]),
        p,
    )


@pytest.mark.parametrize("options", [{}, {"cell_rows": 100, "block_rows": 60, "fanout": 8}])
def test_nearest_label_is_exact(sides, options):
    queries, labelled, q, p, raw = sides
    out = nearest_label(
        queries, labelled, query_id="q", labelled_id="p", label="label",
        pairs=[("a", "x"), ("b", "y"), ("c", "z")], **options,
    ).collect()
    qs = (q - q.mean(0)) / q.std(0)
    ps = (p - p.mean(0)) / p.std(0)
    dist = np.sqrt(((qs[:, None, :] - ps[None]) ** 2).sum(-1))
    assert len(out) == len(q)
    for r in out:
        best = dist[r["qid"]].argmin()
        assert (r["nid"], r["label"]) == (raw[best][0], raw[best][1])
        assert r["distance"] == pytest.approx(dist[r["qid"], best])


def _points(spark, n):
    rng = np.random.default_rng(7)
    rows = [([float(x), float(y)], i, f"l{i % 5}") for i, (x, y) in enumerate(rng.uniform(size=(n, 2)))]
    return spark.createDataFrame(rows, "v array<double>, nid long, label string")


def test_comparisons_stay_bounded_as_the_labelled_side_grows(spark):
    rng = np.random.default_rng(8)
    q = spark.createDataFrame(
        [(i, [float(x), float(y)]) for i, (x, y) in enumerate(rng.uniform(size=(200, 2)))],
        "qid long, v array<double>",
    )
    means = []
    for n in (1_000, 10_000):
        tree = build_tree(_points(spark, n), 2, cell_rows=100, fanout=16, block_rows=500)
        sizes = [r["count"] for r in tree.leaves.groupBy("node", "part").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 100
        compared = [r["compared"] for r in search_tree(q, tree, block_rows=500).collect()]
        assert len(compared) == 200
        means.append(np.mean(compared))
    assert means[1] < 400 and means[1] < 2 * means[0]


def test_cells_that_pivots_cannot_thin_out_are_cut_by_a_hash(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_LEVELS", 1)
    # One pivot takes nearly all: the others lie far away.
    rows = [([float(i % 97), float(i)], i, "near") for i in range(500)]
    rows += [([1e6 + i, 0.0], 1000 + i, "far") for i in range(3)]
    points = spark.createDataFrame(rows, "v array<double>, nid long, label string")
    tree = build_tree(points, 2, cell_rows=30, fanout=2)
    assert tree.leaves.select("node", "part").distinct().count() > 10
    q = spark.createDataFrame([(i, [float(i % 97), i + 0.25]) for i in range(0, 500, 9)], "qid long, v array<double>")
    # blocks of two rows: many of them get no row
    out = {r["qid"]: (r["nid"], r["distance"]) for r in search_tree(q, tree, block_rows=2).collect()}
    assert out == {i: (i, 0.25) for i in range(0, 500, 9)}


def test_no_labelled_rows_no_result_and_queries_without_id_get_none(spark):
    q = spark.createDataFrame([(1, 1.0), (None, 2.0), (3, None)], "q long, a double")
    p = spark.createDataFrame([(7, "x", 1.0), (5, "y", 1.0), (8, None, 3.0)], "p long, label string, z double")
    options = dict(query_id="q", labelled_id="p", label="label", pairs=[("a", "z")])
    assert nearest_label(q, p.limit(0), **options).collect() == []
    out = {r["qid"]: r["nid"] for r in nearest_label(q, p, **options).collect()}
    assert set(out) == {1, 3}
    assert set(out.values()) <= {5, 8}


def test_boxes_spare_cells_for_queries_far_from_all_labelled_vectors(spark):
    """To such queries all pivots are about equally far, whatever the size of the cells."""
    rng = np.random.default_rng(9)
    p = np.column_stack([rng.uniform(size=(4_000, 2)), rng.integers(0, 6, size=(4_000, 3)) / 6])
    q = np.column_stack([rng.uniform(size=(150, 2)), rng.uniform(size=(150, 3)) - [9, -6, 7]])
    points = spark.createDataFrame(
        [(list(map(float, v)), i, "l") for i, v in enumerate(p)], "v array<double>, nid long, label string"
    )
    queries = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(q)], "qid long, v array<double>")
    tree = build_tree(points, 5, cell_rows=60, fanout=16, block_rows=2_000)
    out = search_tree(queries, tree).collect()
    dist = np.sqrt(((q[:, None, :] - p[None]) ** 2).sum(-1))
    assert {r["qid"]: r["nid"] for r in out} == dict(enumerate(dist.argmin(1).tolist()))
    assert np.mean([r["compared"] for r in out]) < 600


def test_a_query_meets_few_vectors_of_a_large_cell(spark):
    """Cells are as large as a task can hold; within one, boxes spare most vectors."""
    rng = np.random.default_rng(11)
    p = np.column_stack([rng.normal(size=(25_000, 2)), rng.integers(0, 5, size=(25_000, 3)) / 5])
    p[1::50] = p[::50]
    q = np.column_stack([rng.normal(size=(200, 2)), rng.normal(size=(200, 3)) * 3])
    q[0], q[1] = p[50], p[77]
    points = spark.createDataFrame([(list(map(float, v)), i, "l") for i, v in enumerate(p)], "v array<double>, nid long, label string")
    queries = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(q)], "qid long, v array<double>")
    tree = build_tree(points, 5)
    assert tree.leaves.select("node", "part").distinct().count() == 1
    out = search_tree(queries, tree).collect()
    dist = np.sqrt(((q[:, None, :] - p[None]) ** 2).sum(-1))
    assert {r["qid"]: r["nid"] for r in out} == dict(enumerate(dist.argmin(1).tolist()))
    assert np.mean([r["compared"] for r in out]) < 1_000


@pytest.mark.parametrize("n", [1, 2, 31, 33, 700])
def test_box_tree_equals_all_pairs(n):
    rng = np.random.default_rng(n)
    p = rng.integers(0, 4, size=(n, 3)).astype(float)  # many equal distances
    q = np.concatenate([rng.integers(0, 4, size=(40, 3)), rng.normal(size=(40, 3)) * 50])
    all_ = np.square(q[:, None, :] - p[None]).sum(-1)
    tree = boxes.BoxTree(p)
    where, dist, seen = tree.nearest(q)
    assert (where == all_.argmin(1)).all() and (dist == all_.min(1)).all() and (seen > 0).all()
    # with a bound: what lies within it is found, and nothing is made up beyond it
    bound = all_.min(1) * np.where(np.arange(len(q)) % 2, 1.0, 0.25)
    again, dist, _ = tree.nearest(q, bound)
    within = all_.min(1) <= bound
    assert (again[within] == where[within]).all() and (dist[again >= 0] == all_.min(1)[again >= 0]).all()
