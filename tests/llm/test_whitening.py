import numpy as np
import pytest

from stratacat.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"x": F.lit("x"), "n": F.lit(1), "component": F.lit(9), "v": F.lit(None).cast("string")})


def brute(rows, components=W.COMPONENTS):
    """``{(position of the row, component): (n, deviation, whitened, explained)}`` by a dense eigensolver."""
    kept = [(k, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for k, (_, v) in enumerate(rows) if v and not any(c is None or not np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    y = (fit - sums / n).astype(float)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for k, x in kept:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        for j in range(min(components, len(e))):
            out[k, j + 1] = (n, deviation, float((np.array(x) - sums / n) @ v[:, j] / np.sqrt(e[j])), e[j] / e.sum())
    return out


def test_matches_a_dense_solver(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 24)) @ rng.standard_normal((24, 24)) * 0.1
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    rows += [rows[0]] * 40 + [(None, rows[3][1]), (900, None), (901, []), (902, [0.5] * 23 + [None]), (903, [0.5] * 23 + [float("nan")]), (904, [float("inf")] * 24), (905, [0.1] * 7)]
    frame(spark, rows).repartition(7).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = W.query(spark, str(tmp_path)).collect()
    want = brute(rows[:-1])
    assert len(got) == len(want) == 16 * 341
    ids = {}
    for (k, j), value in want.items():
        ids.setdefault((rows[k][0], j), []).append(value)
    sign = {}
    for r in got:
        n, deviation, whitened, explained = ids[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation) == (300, deviation)
        assert abs(r.explained / explained - 1) < 1e-10 and r.identity_error < 1e-10
        if abs(whitened) > 1e-6:
            assert sign.setdefault(r.component, np.sign(whitened * r.whitened)) == np.sign(whitened * r.whitened)
        assert abs(abs(whitened) - abs(r.whitened)) < 1e-8


@pytest.mark.parametrize("rows, count", [([], 0), ([(1, [0.5, 1.0])] * 3, 0), ([(1, None)], 0), ([(1, [0.0, 1.0]), (2, [1.0, 1.0])], 2), ([(k, [float(k), -float(k), 1.0]) for k in range(5)], 5)])
def test_few_directions(spark, rows, count):
    """Directions without variance are no components."""
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == count and all(r.component == 1 and abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in got)


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2.0**40 * k), float(k % 3)]) for k in range(6)] + [(7, [float(2.0**60), 0.0])]
    got = W.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == set(range(6))
    assert all(r.deviation is None for r in got)  # beyond long
    assert max(r.identity_error for r in got) < 1e-6


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [7, 7, 7, 2, 2, 1], [1, 0, 0, 0], [3.0] * 6, [1e8, 1, 1e-8], [0.0] * 3, list(range(40))])
def test_spectrum(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(np.array(values, float)) @ q.T
    e, v = W.spectrum(a)
    size = max(np.abs(values).max(), 1)
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-13 * size * len(values)
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13 * len(values)
    assert np.abs(a @ v - v * e).max() < 1e-13 * size * len(values)


def test_polar_factor():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.abs(W.polar(a) - v @ np.diag(np.sign(e)) @ v.T).max() < 1e-12
