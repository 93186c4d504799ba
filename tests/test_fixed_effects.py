import numpy as np
import pytest

from panelloom.functions.fixed_effects import fixed_effects
from panelloom.functions.windows import row_numbers


def dense(rows, terms):
    """Dummies for every unit and period, and the clustered sandwich, by dense matrices."""
    units, periods = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    dummies = [[float(r[0] == u) for u in units] + [float(r[1] == p) for p in periods[1:]] for r in rows]
    y, x = np.array([r[2] for r in rows]), np.array([r[3 : 3 + terms] for r in rows])
    d = np.array(dummies)
    net = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    x, y = net(x), net(y)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    scores = x * (y - x @ beta)[:, None]
    sums = np.array([scores[[r[0] == u for r in rows]].sum(axis=0) for u in units])
    n, g, k = len(rows), len(units), terms + len(periods)
    return beta, np.sqrt(np.diag(inverse @ sums.T @ sums @ inverse) * g / (g - 1) * (n - 1) / (n - k))


SCHEMA = "u string, p int, y double, x double, z double"


@pytest.mark.parametrize("terms", [["x"], ["x", "z"]])
def test_unbalanced_panel_equals_dummies(spark, terms):
    rng = np.random.default_rng(1)
    rows = []
    for u in range(12):
        for p in range(6):
            for _ in range(rng.integers(0, 4) if (u, p) != (3, 2) else 60):  # gaps, repeats and one heavy cell
                x, z = rng.normal() + u / 5, float(u > 5 and p > 2) + 0.1 * rng.normal()
                rows.append((f"u{u}", p, float(2 * x - 3 * z + u + p * p + rng.normal()), float(x), float(z)))
    odd = [(None, 1, 1.0, 1.0, 1.0), ("u1", None, 1.0, 1.0, 1.0), ("u1", 1, None, 1.0, 1.0),
           ("u1", 1, 1.0, float("nan"), float("nan")), ("u1", 1, float("inf"), 1.0, 1.0)]
    found = fixed_effects(spark.createDataFrame(rows + odd, SCHEMA), "y", terms, "u", "p").collect()
    beta, errors = dense(rows, len(terms))
    assert [r.term for r in found] == terms and {(r.n, r.clusters) for r in found} == {(len(rows), 12)}
    assert [r.estimate for r in found] == pytest.approx(beta.tolist(), abs=1e-7)
    assert [r.std_error for r in found] == pytest.approx(errors.tolist(), rel=1e-6)
    assert [r.t for r in found] == pytest.approx((beta / errors).tolist(), rel=1e-6)


def test_terms_that_the_effects_explain_and_no_rows(spark):
    rows = [(f"u{u}", p, float(u * p), float(u), float(p * p)) for u in range(4) for p in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r[1:4] for r in fixed_effects(df, "y", ["x", "z"], "u", "p").collect()] == [(None, None, None)] * 2
    nothing = fixed_effects(df.limit(0), "y", ["x"], "u", "p").collect()
    assert [tuple(r) for r in nothing] == [("x", None, None, None, 0, 0)]


def test_row_numbers_without_gaps(spark):
    rows = [("a", i % 7) for i in range(300)] + [(None, i) for i in range(5)] + [("b", None)]
    numbered = row_numbers(spark.createDataFrame(rows, "file string, k int"), "row", ["file"], ["k"], blocks=8)
    assert numbered.columns == ["row", "file", "k"]
    got = numbered.collect()
    for file in ("a", "b", None):
        own = sorted((r.row, r.k) for r in got if r.file == file)
        assert [n for n, _ in own] == list(range(1, len(own) + 1))
        assert [k for _, k in own] == sorted(k for f, k in rows if f == file)
