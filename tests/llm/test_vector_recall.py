"""Predicted recall of the spherical-cap filters on tables that no test can hold."""

import numpy as np
import pytest

from quillspark.llm import nearvec


@pytest.mark.parametrize("n", [10**6, 10**7, 10**8])
def test_recall_on_large_tables(n):
    code = nearvec.Filters(n, 64, 0.95, seed=3)
    g = np.random.default_rng(8)
    x, y = g.standard_normal((2, 500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = 0
    for i in range(len(x)):
        (_, a), (_, b) = code.decode(x[i : i + 1]), code.decode(y[i : i + 1])
        met += bool(np.intersect1d(a, b).size)
    assert met >= 0.98 * len(x)
    rows, found = code.decode(x)
    assert sorted(zip(rows.tolist(), found.tolist(), strict=True)) == sorted((i, f) for i in range(len(x)) for f in code.decode(x[i : i + 1])[1].tolist())


@pytest.mark.parametrize(("name", "value"), [("MOST", 1), ("RECALL", 1.1)])
def test_missed_links_are_an_error(monkeypatch, name, value):
    monkeypatch.setattr(nearvec, name, value)
    with pytest.raises(ValueError, match="codes"):
        nearvec.Filters(10**4, 64, 0.95, seed=3)


def test_vectors_of_other_lengths(spark):
    base = np.random.default_rng(4).standard_normal((6, 8))
    rows = [(i, x.tolist()) for i, x in enumerate([*base, *base[:3], 2 * base[0]])] + [(20, [1.0] * 9), (30, [1.0]), (31, [2.0]), (32, [-1.0]), (40, [1.0, 2.0]), (41, [2.0, 4.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nearvec.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, seed=2).collect()}
    want = {0: (2, 0), 6: (2, 0), 9: (2, 0), 1: (1, 1), 7: (1, 1), 2: (1, 2), 8: (1, 2), 30: (1, 30), 31: (1, 30), 40: (1, 40), 41: (1, 40)}
    assert got == want | {i: (0, i) for i in (3, 4, 5, 20, 32)}
