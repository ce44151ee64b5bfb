"""Whitened components against numpy's own, exact sums against Python's integers."""

import numpy as np
import pytest

from filingmill.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, label int, row int, block int, x string, part int, component string"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, v, 1, 2, 3, "x", 4, "c") for i, v in enumerate(vectors)], COLUMNS)


def expected(vectors, k=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = ((n * x - s) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    k = min(k, x.shape[1])
    values, axes = values[::-1], axes[:, ::-1]
    return n, deviation, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize(("rows", "d", "block_rows"), [(700, 12, 64), (300, 5, 1000), (40, 3, 1), (400, 20, None)])
def test_components_equal_those_of_numpy(spark, monkeypatch, rows, d, block_rows):
    monkeypatch.setattr(whitening, "PANEL_BLOCKS", 8)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 7)
    rng = np.random.default_rng(rows)
    vectors = (rng.normal(size=(rows, d)) * np.linspace(3, 0.2, d) + 1).astype(np.float32).tolist()
    n, deviation, whitened, explained = expected(vectors)
    k = min(8, d)
    got = whitening.whiten(frame(spark, vectors).repartition(5), 8, block_rows).collect()
    assert len(got) == rows * k and {r.n for r in got} == {n}
    found = np.full((rows, k), np.nan)
    for r in got:
        found[r.vec_id, r.component - 1] = r.whitened
        assert int(r.deviation) == deviation[r.vec_id]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    signs = np.sign((found * whitened).sum(axis=0))
    assert np.abs(found - whitened * signs).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_rows_left_out_and_rows_repeated(spark):
    good = np.random.default_rng(1).normal(size=(60, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    df = frame(spark, good).union(frame(spark, good[:2])).union(frame(spark, bad, 100)).union(spark.createDataFrame([(None, good[5], 1, 2, 3, "x", 4, "c")], COLUMNS))
    got = whitening.whiten(df).collect()
    assert len(got) == 63 * 3 and {r.n for r in got} == {63} and {r.vec_id for r in got} == {None, *range(60)}
    _, _, _, explained = expected([*good, *good[:2], good[5]])
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-9 for r in got)


def test_nothing_varies(spark):
    got = whitening.whiten(frame(spark, [[0.5, 0.25]] * 4)).collect()
    assert len(got) == 8 and {(int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got} == {(0, None, None, 0.0)}
    flat = whitening.whiten(frame(spark, [[i / 7, 1.0, i / 7] for i in range(30)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and {r.identity_error < 1e-9 for r in flat} == {True}
    assert whitening.whiten(frame(spark, [None, []])).count() == 0 and whitening.whiten(frame(spark, [])).count() == 0


def test_sums_beyond_64_bits_are_exact(spark):
    vectors = [[4.0e12, -1.0], [-4.0e12, 3.0], [1.0e12, 2.0], [2.5e11, 2.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    x = np.array([[int(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    want = ((4 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert {(r.vec_id, int(r.deviation)) for r in whitening.whiten(df).collect()} == set(enumerate(want))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()
