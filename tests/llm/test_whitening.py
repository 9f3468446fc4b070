import numpy as np
import pytest

from backhaul.llm.bidiagonal import right_singular
from backhaul.llm.whitening import LARGEST, RESULT, whiten

SCHEMA = "vec_id long, embedding array<float>, x string, n int"


def matrices():
    rng = np.random.default_rng(0)
    left, right = (np.linalg.qr(rng.standard_normal((48, 48)))[0] for _ in range(2))
    repeated = np.ones(48)
    repeated[:5] = [10, 10, 10, 5, 5]
    near = np.full(48, 3.0)
    near[::2] += 1e-9 * rng.standard_normal(24)
    copied = rng.standard_normal((30, 30))
    copied[:, 4], copied[:, 7] = copied[:, 5], 0
    return {
        "one": rng.standard_normal((1, 1)),
        "two": rng.standard_normal((2, 2)),
        "plain": rng.standard_normal((48, 48)),
        "wide": rng.standard_normal((200, 200)),
        "identity": np.eye(20),
        "rotation": left,
        "columns_repeat": copied,
        "values_repeat": left @ np.diag(repeated) @ right,
        "values_nearly_repeat": left @ np.diag(near) @ right,
        "graded": rng.standard_normal((40, 40)) * 10.0 ** (np.arange(40) / 4),
        "steps": np.linalg.cholesky(np.diag(np.abs(np.arange(21) - 10.0) + 2) + np.eye(21, k=1) + np.eye(21, k=-1)).T,
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_right_singular(name):
    matrix = matrices()[name]
    squares, vectors = right_singular(matrix, 16)
    plain = np.linalg.svd(matrix, compute_uv=False) ** 2
    k = vectors.shape[1]
    assert k == min(16, len(matrix))
    assert np.abs(squares - plain).max() <= 1e-13 * plain[0]
    assert np.abs(squares[:k] / plain[:k] - 1).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10
    assert np.abs(matrix.T @ (matrix @ vectors) - vectors * squares[:k]).max() < 1e-12 * plain[0]


def test_singular_matrices():
    assert right_singular(np.zeros((4, 4)), 16)[1].shape == (4, 0)
    line = np.outer(np.arange(5.0), np.arange(1, 6.0))
    squares, vectors = right_singular(np.linalg.qr(line, "r"), 16)
    assert vectors.shape == (5, 1)
    assert np.isclose(squares[0], np.linalg.norm(line) ** 2)


def plain_whitening(rows):
    """(vec_id, x) rows, S, n, falling eigenvalues and vectors by the covariance itself."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    size = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] + [1_000_000] * (size - len(v)) for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in kept], x, n, sums, values[::-1], vectors[:, ::-1]


def found(df):
    rows = sorted(df.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["deviation"], r["component"]))
    return rows, np.array([r["whitened"] for r in rows])


def test_equals_the_covariance_way(spark):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((24, 24)) * 1.3 ** -np.arange(24)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 24)) @ mix)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # copies weigh nothing
    rows += [(2000, None), (2001, [float("nan")] * 24), (2002, [None] * 24), (2003, [float("inf")] + [0.0] * 23)]
    rows += [(2004, [0.5] * 3), (2005, []), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], SCHEMA).repartition(40)
    out = whiten(df)
    assert out.schema.simpleString() == spark.createDataFrame([], RESULT).schema.simpleString()
    ids, x, n, sums, values, vectors = plain_whitening(rows)
    got, whitened = found(out)
    assert len(got) == len(ids) * 16
    assert {r["n"] for r in got} == {n}
    exact = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for i, row in zip(ids, x)}
    assert all(r["deviation"] == exact[r["vec_id"]] for r in got)
    assert max(r["identity_error"] for r in got) < 1e-10
    for r in got[:16]:
        assert np.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rtol=1e-10)
    plain = (x - sums / n) @ vectors[:, :16] / np.sqrt(values[:16])
    by_place = {(r["vec_id"], r["component"]): r["whitened"] for r in got}  # the repeated row has the same values
    whitened = np.array([[by_place[i, c] for c in range(1, 17)] for i in ids])
    sign = np.sign((plain * whitened).sum(axis=0))
    assert np.abs(whitened - plain * sign).max() < 1e-8


def test_fewer_directions_than_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)] + [(None, [3.0, 6.0, 1.0])]
    got, whitened = found(whiten(spark.createDataFrame([(i, v, "a", 1) for i, v in rows], SCHEMA)))
    assert len(got) == 21 and {r["component"] for r in got} == {1}
    assert np.isclose(np.var(whitened[:20]), 1)
    assert got[-1]["vec_id"] is None and np.isclose(whitened[-1], whitened[3])


def test_wide_entries_stay_exact(spark):
    rows = [(1, [float(1 << 30), 0.0]), (2, [-float(1 << 30), 1.0]), (3, [0.0, 5.0]), (4, [2 * LARGEST, 0.0])]
    got, _ = found(whiten(spark.createDataFrame([(i, v, "a", 1) for i, v in rows], SCHEMA)))
    x = [[64 << 30, 0], [-(64 << 30), 64], [0, 320]]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x, 1)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == exact


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, None)]])
def test_nothing_to_whiten(spark, rows):
    assert whiten(spark.createDataFrame([(i, v, "a", 1) for i, v in rows], SCHEMA)).collect() == []
