"""Queries of input-output algebra, over the trade between nations in the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.maths import rounded
from tidemill.operators import matrix as M
from tidemill.plans.registry import Registry
from tidemill.session import cut
from tidemill.sources.tables import Tables

R = Registry()
#: Doublings of the series in the SQL checks: 2^DOUBLINGS terms, whose last power is far below a double's precision for column sums up to 0.95.
DOUBLINGS = 10

_FLOWS = """WITH flows AS (
    SELECT s.s_nationkey || '' AS i, c.c_nationkey || '' AS j, sum(l_extendedprice) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY ALL),
codes AS (SELECT n_nationkey || '' AS i FROM nation),
outs AS (SELECT c.j, c.x + r.x AS o FROM (SELECT j, sum(x) AS x FROM flows GROUP BY j) c JOIN (SELECT i, sum(x) AS x FROM flows GROUP BY i) r ON c.j = r.i),
a1 AS (SELECT i, j, x / o AS x FROM flows JOIN outs USING (j))"""
_SQUARE = ",\na2 AS (SELECT p.i, q.j, sum(p.x * q.x) AS x FROM a1 p JOIN a1 q ON p.j = q.i GROUP BY ALL)"
# The whole inverse in SQL: p = A^(2^k) and s = the sum of the first 2^k powers, doubled until nothing is added any more.
_LEONTIEF = _FLOWS + ",\np0 AS MATERIALIZED (SELECT * FROM a1), s0 AS MATERIALIZED (SELECT i, i AS j, 1.0::DOUBLE AS x FROM codes)" + "".join(
    f",\ns{k} AS MATERIALIZED (SELECT i, j, sum(x) AS x FROM (SELECT * FROM s{k - 1} UNION ALL SELECT p.i, q.j, p.x * q.x FROM p{k - 1} p JOIN s{k - 1} q ON p.j = q.i) GROUP BY ALL),"
    f"\np{k} AS MATERIALIZED (SELECT p.i, q.j, sum(p.x * q.x) AS x FROM p{k - 1} p JOIN p{k - 1} q ON p.j = q.i GROUP BY ALL)"
    for k in range(1, DOUBLINGS + 1)
) + f",\nl AS (SELECT * FROM s{DOUBLINGS})"
_R6 = lambda c: f"floor({c} * 1e6 + 0.5) / 1e6"


def flows(t: Tables) -> DataFrame:
    """Revenue from the supplier's nation (i) to the customer's (j): a cell for each pair of nations, cut, as everything else is derived from it.

    Lines meet suppliers first, which Spark broadcasts where they are small, and are summed by order and nation before they are shuffled to their orders.
    """
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    summed = lines.groupBy("l_orderkey", "s_nationkey").agg(F.sum("l_extendedprice").alias("x"))
    orders = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = summed.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return cut(joined.groupBy(F.col("s_nationkey").cast("string").alias("i"), F.col("c_nationkey").cast("string").alias("j")).agg(F.sum("x").alias("x")))


def codes(t: Tables) -> DataFrame:
    """The nations."""
    return t.nation.select(F.col("n_nationkey").cast("string").alias("i"))


def coefficients(t: Tables) -> DataFrame:
    """A; the output of a nation is what it buys and what it sells."""
    cells = flows(t)
    output = cells.select(F.explode(F.array("i", "j")).alias("j"), "x").groupBy("j").agg(F.sum("x").alias("x"))
    return M.technical_coefficients(cells, output)


def leontief(t: Tables) -> DataFrame:
    """L as a series, until its powers vanish."""
    return M.leontief_converged(cut(coefficients(t)), codes(t))


def inverse(t: Tables) -> DataFrame:
    """L inverted in one task, for linkages and shocks."""
    names = sorted(r["i"] for r in codes(t).collect())  # the list of nations is fixed
    return M.leontief_inverse(coefficients(t), names)


def six(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six digits."""
    return df.withColumns({n: rounded(F.col(n)) for n in names})


@R.query("tech_coefficients", f"{_FLOWS} SELECT i, j, {_R6('x')} AS x FROM a1")
def tech_coefficients(t: Tables) -> DataFrame:
    """L01."""
    return six(coefficients(t), "x")


@R.query("matrix_product", f"{_FLOWS}{_SQUARE} SELECT i, j, {_R6('x')} AS x FROM a2")
def matrix_product(t: Tables) -> DataFrame:
    """A times A."""
    return six(M.product(coefficients(t), coefficients(t)), "x")


@R.query("leontief_neumann", f"{_LEONTIEF} SELECT i, j, {_R6('x')} AS x FROM l")
def leontief_neumann(t: Tables) -> DataFrame:
    """L02 as a series."""
    return six(leontief(t), "x")


@R.query("leontief_exact", f"{_LEONTIEF} SELECT i, j, {_R6('x')} AS x FROM l")
def leontief_exact(t: Tables) -> DataFrame:
    """L02 inverted in one task."""
    return six(inverse(t), "x")


@R.query("leontief_identity", f"{_FLOWS} SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM codes a, codes b")
def leontief_identity(t: Tables) -> DataFrame:
    """L times I - A, which is the unit matrix to the ninth digit."""
    a = cut(coefficients(t))
    rest = M.total(M.identity(codes(t)), a.withColumn("x", -F.col("x")))
    found = M.product(M.leontief_inverse(a, sorted(r["i"] for r in codes(t).collect())), rest)
    return found.withColumn("x", rounded(F.col("x"), 9) + F.lit(0.0))


@R.query("matrix_compare", "SELECT true AS all_close, true AS within_1e_9")
def matrix_compare(t: Tables) -> DataFrame:
    """The series against the exact inverse."""
    return M.compare(leontief(t), inverse(t)).select("all_close", (F.greatest("max_abs", "mean_abs", "rmse") < 1e-9).alias("within_1e_9"))


_TRADE = """WITH sales AS (
    SELECT s.s_nationkey || '' AS i, l_returnflag AS component, l_partkey % 40 || '' AS p, c.c_nationkey || '' AS j, sum(l_extendedprice) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY ALL),
made AS (SELECT i, p, sum(x) / sum(sum(x)) OVER (PARTITION BY p) AS x FROM sales GROUP BY i, p),
outs AS (SELECT i, sum(x) * 2 AS o FROM sales GROUP BY i),
used AS (SELECT p, j, sum(sales.x) / any_value(o) AS x FROM sales JOIN outs ON sales.j = outs.i GROUP BY p, j)"""


def sales(t: Tables) -> DataFrame:
    """Revenue by supplier's nation (i), kind of part (p), customer's nation (j) and component of demand (the return flag), written once."""
    orders = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_extendedprice").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    text = lambda c: F.col(c).cast("string")
    kind = (F.col("l_partkey") % 40).cast("string")
    keys = [text("s_nationkey").alias("i"), F.col("l_returnflag").alias("component"), kind.alias("p"), text("c_nationkey").alias("j")]
    return cut(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(*keys).agg(F.sum("l_extendedprice").alias("x")))


@R.query("coefficients_by_products", f"{_TRADE} SELECT m.i, u.j, {_R6('sum(m.x * u.x)')} AS x FROM made m JOIN used u ON m.p = u.p GROUP BY m.i, u.j")
def coefficients_by_products(t: Tables) -> DataFrame:
    """A = D x Bn, the market shares of sectors in products times the products that a unit of each sector's output takes."""
    sold = sales(t)
    shares = M.market_shares(sold.groupBy("i", F.col("p").alias("j")).agg(F.sum("x").alias("x")))
    output = sold.groupBy(F.col("i").alias("j")).agg((F.sum("x") * 2).alias("x"))
    uses = M.technical_coefficients(sold.groupBy(F.col("p").alias("i"), "j").agg(F.sum("x").alias("x")), output)
    M.same_codes(shares.select("j"), uses.select(F.col("i").alias("j")), "j")
    return six(M.product(shares, uses), "x")


@R.query("final_demand_by_sector", f"{_TRADE}, demand AS (SELECT p, component, sum(x) AS x FROM sales GROUP BY ALL) SELECT m.i, d.component AS j, {_R6('sum(m.x * d.x)')} AS x FROM made m JOIN demand d ON m.p = d.p GROUP BY ALL")
def final_demand_by_sector(t: Tables) -> DataFrame:
    """Final demand of products by component, checked against its totals and carried to sectors as D x F."""
    sold = sales(t)
    shares = M.market_shares(sold.groupBy("i", F.col("p").alias("j")).agg(F.sum("x").alias("x")))
    demand = M.checked_demand(sold.groupBy(F.col("p").alias("i"), F.col("component").alias("j")).agg(F.sum("x").alias("x")), sold.groupBy(F.col("p").alias("i")).agg(F.sum("x").alias("total")))
    return six(M.product(shares, demand), "x")


_LINKS = _LEONTIEF + """, g AS (SELECT sum(x) AS s FROM l), f AS (SELECT i, sum(x) AS r FROM l GROUP BY i), b AS (SELECT j AS i, sum(x) AS c FROM l GROUP BY j),
links AS (SELECT codes.i, coalesce(r, 0) * (SELECT count(*) FROM codes) / s AS forward_linkage, coalesce(c, 0) * (SELECT count(*) FROM codes) / s AS backward_linkage FROM codes LEFT JOIN f USING (i) LEFT JOIN b USING (i) CROSS JOIN g)"""


@R.query("linkages", f"{_LINKS} SELECT i, {_R6('forward_linkage')} AS forward_linkage, {_R6('backward_linkage')} AS backward_linkage, CASE WHEN forward_linkage >= 1 AND backward_linkage >= 1 THEN 'III' WHEN forward_linkage >= 1 THEN 'II' WHEN backward_linkage >= 1 THEN 'IV' ELSE 'I' END AS sector_type FROM links")
def linkages(t: Tables) -> DataFrame:
    """L03, L04."""
    return six(M.linkages(cut(inverse(t)), codes(t)), "forward_linkage", "backward_linkage")


def deltas(t: Tables) -> DataFrame:
    """Three shocks: one sector, a share of all final demand, and the same rescaled to the first's total."""
    demand = flows(t).groupBy(F.col("i")).agg(F.sum("x").alias("x"))
    tenth = M.percentage_shock("tenth", demand, 0.1)
    return M.sector_shock("one", codes(t), "7", 1_000_000.0).unionByName(tenth).unionByName(M.rescaled(tenth, 1_000_000.0).withColumn("scenario", F.lit("tenth_rescaled")))


_SHOCK = _LEONTIEF + """, demand AS (SELECT i AS j, sum(x) * 0.1 AS d FROM flows GROUP BY 1),
deltas AS (SELECT 'one' AS scenario, '7' AS j, 1000000.0::DOUBLE AS d UNION ALL SELECT 'tenth', j, d FROM demand UNION ALL SELECT 'tenth_rescaled', j, d * 1000000.0 / (SELECT sum(d) FROM demand) FROM demand),
moved AS (SELECT scenario, i, sum(x * d) AS total FROM l JOIN deltas USING (j) GROUP BY ALL),
shocked AS (SELECT m.scenario, m.i, coalesce(d, 0) AS direct, total, total - coalesce(d, 0) AS indirect FROM moved m LEFT JOIN deltas e ON e.scenario = m.scenario AND e.j = m.i)"""
_R2 = lambda c: f"floor({c} * 1e2 + 0.5) / 1e2"


@R.query("shock_impacts", f"{_SHOCK} SELECT scenario, i, {_R2('direct')} AS direct, {_R2('total')} AS total, {_R2('indirect')} AS indirect FROM shocked")
def shock_impacts(t: Tables) -> DataFrame:
    """L05, L06, L07."""
    return M.shock(inverse(t), deltas(t)).withColumns({c: rounded(F.col(c), 2) for c in ("direct", "total", "indirect")})


@R.query("scenario_compare", f"""{_SHOCK}, s AS (SELECT scenario, sum(direct) AS direct, sum(total) AS total, sum(indirect) AS indirect FROM shocked GROUP BY 1)
SELECT scenario, {_R2('direct')} AS direct, {_R2('total')} AS total, {_R2('indirect')} AS indirect, {_R6('total / direct')} AS multiplier, {_R6('indirect / total')} AS indirect_share FROM s""")  # fmt: skip
def scenario_compare(t: Tables) -> DataFrame:
    """L07."""
    return six(M.compare_scenarios(M.shock(inverse(t), deltas(t))).withColumns({c: rounded(F.col(c), 2) for c in ("direct", "total", "indirect")}), "multiplier", "indirect_share")


@R.query("top_impacts", f"{_SHOCK} SELECT scenario, i, {_R2('total')} AS total, rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY total DESC, i) AS rank FROM shocked) WHERE rank <= 8")
def top_impacts(t: Tables) -> DataFrame:
    """The eight sectors that each scenario moves most."""
    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("total"), "i")).cast("long")
    return M.shock(inverse(t), deltas(t)).withColumn("rank", best).filter("rank <= 8").select("scenario", "i", rounded(F.col("total"), 2).alias("total"), "rank")


@R.query("coefficients_wide", f"{_FLOWS} SELECT i, " + ", ".join(f"coalesce(sum({_R6('x')}) FILTER (j = '{k}'), 0) AS n{k}" for k in range(25)) + " FROM a1 GROUP BY i")
def coefficients_wide(t: Tables) -> DataFrame:
    """A with one column per nation."""
    names = sorted((r["i"] for r in codes(t).collect()), key=int)
    return M.wide(six(coefficients(t), "x"), names).withColumnsRenamed({n: f"n{n}" for n in names})
