import hashlib

import numpy as np
import pytest

from ledgerlens.llm import codes


def brute(x, seeds, parts, rounds):
    """Codes, squared distances and codebooks by measuring everything."""
    cut = x.reshape(len(x), parts, -1)
    books = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    for i in range(rounds + 1):
        d = np.square(cut[:, :, None, :] - books[None]).sum(axis=3)
        code, least = d.argmin(axis=2), d.min(axis=2)
        if i == rounds:
            return code, least, books
        for p in range(parts):
            for e in range(len(seeds)):
                mine = cut[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]


@pytest.mark.parametrize("groups", [1, 3, 8, 64])
def test_bounds_spare_work_and_change_nothing(groups):
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (20, 2, 3))
    x = centres[rng.integers(0, 20, 900)] + rng.integers(-9, 9, (900, 2, 3))
    books = [x[:20].transpose(1, 0, 2).copy()]
    state = codes.Bounds(books, groups).start(len(x))
    for _ in range(5):
        work = codes.Bounds(books, groups)
        code, squared, bound, stamp = work.assign(x, *state)
        d = np.square(x[:, :, None, :] - books[-1][None]).sum(axis=3)
        np.testing.assert_array_equal(code, d.argmin(axis=2))
        np.testing.assert_array_equal(squared, d.min(axis=2))
        state = code, bound, stamp
        moved = books[-1].copy()
        for p in range(2):
            for e in range(20):
                if (mine := x[code[:, p] == e, p]).size:
                    moved[p, e] = mine.sum(axis=0) // len(mine)
        books.append(moved)
    # some bounds still carry an older stamp than the last round
    assert (stamp < len(books) - 2).any()


def test_net_displacement_is_not_the_sum_of_moves():
    there, back = np.zeros((1, 2, 2), np.int64), np.array([[[30, 40], [0, 0]]])
    work = codes.Bounds([there, back, there], 1)
    assert work.net[0].max() == 0 and work.net[1, 0, 0, 1] == 50


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        v = (rng.normal(0, 0.3, 32)).astype(np.float32).tolist()
        rows.append((int(i) if i % 50 else None, v, int(rng.integers(0, 4)) if i % 9 else None))
    rows += [rows[3]] * 300 + [(5000, None, 1), (5001, [float("nan")] * 32, 1), (5002, [1.0] * 31 + [None], 2), (5003, [float("inf")] * 32, 2)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, error int").repartition(6)
    coded, books = codes.compress(df, entries=24)
    out = codes.with_label_error(coded).collect()
    kept = rows[:1000]
    x = np.floor(np.array([r[1] for r in kept], dtype=np.float64) * 256).astype(np.int64)
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:24]
    seeds = np.floor(np.array([r[1] for r in order], dtype=np.float64) * 256).astype(np.int64)
    code, least, want = brute(x, seeds, 16, 2)
    np.testing.assert_array_equal(books, want)
    told = [(r[0], r[2], "".join(f"{c:02x}" for c in cs), int(e)) for r, cs, e in zip(kept, code, least.sum(axis=1))]
    totals = {}
    for _, label, _, e in told:
        totals[label] = totals.get(label, 0) + e
    key = lambda r: tuple((v is None, v or 0) for v in r)
    want_rows = sorted(((i, l, c, e, totals[l]) for i, l, c, e in told), key=key)
    assert sorted(((r.id, r.label, r.code, r.error, r.label_error) for r in out), key=key) == want_rows
    digest = hashlib.sha256(",".join(str(int(n)) for n in want.ravel()).encode()).hexdigest()
    assert codes.codebook_digest(books) == digest


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(2, [0.5] * 16, 1), (1, [-0.001] * 16, None)], schema)
    coded, books = codes.compress(df)
    assert {(r.id, r.code, r.error) for r in coded.collect()} == {(1, "00" * 16, 0), (2, "01" * 16, 0)}
    assert books[0].ravel().tolist() == [-1, 128]
    coded, books = codes.compress(df.limit(0))
    assert coded.isEmpty() and codes.with_label_error(coded).isEmpty() and not books.size


def test_odd_vectors_raise(spark):
    df = spark.createDataFrame([(1, [0.5] * 15, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        codes.compress(df)
