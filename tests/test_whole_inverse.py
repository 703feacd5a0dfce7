"""Linkages and shocks take the whole inverse, and the series goes on until its powers vanish."""

from types import SimpleNamespace

import numpy as np
import pytest

from tests.test_matrix import cells, dense
from tidemill.operators import matrix as M
from tidemill.plans import algebra

# Three nations that sell nearly all they make to each other, so that the powers vanish slowly: column sums of A are near 1.
SALES = [(0, 1, 100.0), (1, 2, 100.0), (2, 0, 90.0), (0, 0, 800.0), (1, 1, 10.0), (2, 2, 5.0), (1, 0, 1.0)]


def trade(spark):
    lines = [(k, s, x) for k, (s, _, x) in enumerate(SALES)]
    return SimpleNamespace(
        lineitem=spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_extendedprice double"),
        orders=spark.createDataFrame([(k, c) for k, (_, c, _) in enumerate(SALES)], "o_orderkey long, o_custkey long"),
        customer=spark.createDataFrame([(k, k) for k in range(3)], "c_custkey long, c_nationkey long"),
        supplier=spark.createDataFrame([(k, k) for k in range(3)], "s_suppkey long, s_nationkey long"),
        nation=spark.createDataFrame([(k,) for k in range(3)], "n_nationkey long"),
    )


def whole():
    x = np.zeros((3, 3))
    for i, j, v in SALES:
        x[i, j] += v
    return x, np.linalg.inv(np.eye(3) - x / (x.sum(0) + x.sum(1)))


def test_queries_take_the_whole_inverse(spark):
    t, (x, want) = trade(spark), whole()
    assert np.abs(dense(algebra.leontief_neumann(t), 3) - want).max() < 1e-6
    linked = {int(r["i"]): r for r in algebra.linkages(t).collect()}
    for k in range(3):
        assert abs(linked[k]["forward_linkage"] - want[k].sum() * 3 / want.sum()) < 1e-6
        assert abs(linked[k]["backward_linkage"] - want[:, k].sum() * 3 / want.sum()) < 1e-6
    tenth = want @ (x.sum(1) * 0.1)
    moved = {int(r["i"]): r["total"] for r in algebra.shock_impacts(t).filter("scenario = 'tenth'").collect()}
    assert all(abs(moved[k] - tenth[k]) < 0.011 for k in range(3))
    scenario = algebra.scenario_compare(t).filter("scenario = 'tenth'").first()
    assert abs(scenario["multiplier"] - tenth.sum() / (x.sum() * 0.1)) < 2e-6
    top = algebra.top_impacts(t).filter("scenario = 'tenth' and rank = 1").first()
    assert int(top["i"]) == tenth.argmax() and abs(top["total"] - tenth.max()) < 0.011


def test_series_of_slow_powers(spark):
    a = np.array([[0.5, 0.49], [0.49, 0.5]])
    codes = spark.createDataFrame([("0",), ("1",)], "i string")
    assert np.allclose(dense(M.leontief_converged(cells(spark, a), codes), 2), np.linalg.inv(np.eye(2) - a), rtol=1e-9)
    with pytest.raises(RuntimeError):
        M.leontief_converged(cells(spark, [[0.6, 0.6], [0.6, 0.6]]), codes)
