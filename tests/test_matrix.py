"""Input-output algebra on closed forms."""

import numpy as np
import pytest

from tests.conftest import rows
from tidemill.operators import matrix as M


def cells(spark, a):
    return spark.createDataFrame([(str(i), str(j), float(x)) for i, r in enumerate(a) for j, x in enumerate(r) if x], "i string, j string, x double")


def dense(df, n, m=None):
    out = np.zeros((n, m or n))
    for r in df.collect():
        out[int(r["i"]), int(r["j"])] = r["x"]
    return out


def test_product(spark):
    a, b = np.array([[0.2, 0.8], [0.5, 0.5]]), np.array([[0.1, 0.0], [0.25, 0.2]])
    assert np.allclose(dense(M.product(cells(spark, a), cells(spark, b)), 2), a @ b)


def test_inverse_two_ways(spark):
    rng = np.random.default_rng(1)
    a = rng.random((6, 6))
    a = a / a.sum(0) * 0.4
    codes = spark.createDataFrame([(str(k),) for k in range(6)], "i string")
    exact = M.leontief_inverse(cells(spark, a), [str(k) for k in range(6)])
    assert np.allclose(dense(exact, 6) @ (np.eye(6) - a), np.eye(6))
    assert np.abs(dense(M.leontief_series(cells(spark, a), codes, 9), 6) - dense(exact, 6)).max() < 0.4**9 * 2
    assert M.compare(exact, exact).first().asDict() == {"max_abs": 0.0, "mean_abs": 0.0, "rmse": 0.0, "all_close": True}


def test_linkages_average_to_one_and_one_is_high(spark):
    """Of [[2, 1], [0, 5]] the rows sum to 3 and 5 and the columns to 2 and 6, around a mean of 4."""
    codes = spark.createDataFrame([("0",), ("1",)], "i string")
    got = rows(M.linkages(cells(spark, [[2.0, 1.0], [0.0, 5.0]]), codes), "i", "forward_linkage", "backward_linkage", "sector_type")
    assert got == [("0", 0.75, 0.5, "I"), ("1", 1.25, 1.5, "III")]
    types = spark.createDataFrame([(1.0, 1.0), (3.0, 0.25), (0.25, 3.0), (0.5, 0.75)], "f double, b double")
    assert [r[0] for r in types.select(M.sector_type(types.f, types.b)).collect()] == ["III", "II", "IV", "I"]


def test_shocks(spark):
    """40 asked of sector 1 of [[2, 1], [0, 5]] moves 40 in sector 0 and 200 in sector 1, six times what was asked."""
    codes = spark.createDataFrame([("0",), ("1",)], "i string")
    lf = cells(spark, [[2.0, 1.0], [0.0, 5.0]])
    moved = M.shock(lf, M.sector_shock("s", codes, "1", 40.0))
    assert rows(moved, "i", "direct", "total", "indirect") == [("0", 0.0, 40.0, 40.0), ("1", 40.0, 200.0, 160.0)]
    assert rows(M.compare_scenarios(moved), "multiplier") == [(6.0,)]
    demand = spark.createDataFrame([("0", 60.0), ("1", 20.0)], "i string, x double")
    assert rows(M.rescaled(M.percentage_shock("p", demand, 0.25), 4.0), "j", "x") == [("0", 3.0), ("1", 1.0)]
    nothing = M.percentage_shock("p", demand, 0.0)
    assert M.rescaled(nothing, 4.0).count() == 0
    assert rows(M.compare_scenarios(M.shock(lf, nothing)), "multiplier") == [(None,)]


def test_shares_and_demand(spark):
    """Two sectors make 3 and 1 of a product; demand whose components miss their total is refused."""
    made = spark.createDataFrame([("0", "p", 3.0), ("1", "p", 1.0), ("1", "q", 0.0)], "i string, j string, x double")
    shares = M.market_shares(made)
    assert rows(shares, "i", "j", "x") == [("0", "p", 0.75), ("1", "p", 0.25)]
    demand = spark.createDataFrame([("p", "home", 6.0), ("p", "abroad", 2.0)], "i string, j string, x double")
    totals = lambda x: spark.createDataFrame([("p", x)], "i string, total double")
    assert rows(M.product(shares, M.checked_demand(demand, totals(8.0))), "i", "j", "x") == [("0", "abroad", 1.5), ("0", "home", 4.5), ("1", "abroad", 0.5), ("1", "home", 1.5)]
    with pytest.raises(ValueError, match="'p'"):
        M.checked_demand(demand, totals(9.0))


def test_codes_must_agree(spark):
    a = spark.createDataFrame([("0",), ("1",)], "i string")
    M.same_codes(a, a, "i")
    with pytest.raises(ValueError, match="1"):
        M.same_codes(a, a.filter("i = '0'"), "i")
