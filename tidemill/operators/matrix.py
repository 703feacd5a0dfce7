"""Input-output algebra on matrices of rows (i, j, x)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.maths import ratio
from tidemill.session import cut


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """A times B as a join on the inner index and a sum; cells without a term are left out, as zeros are."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("x").alias("xa")), b.select(F.col("i").alias("k"), "j", F.col("x").alias("xb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("xa") * F.col("xb")).alias("x"))


def total(*parts: DataFrame) -> DataFrame:
    """Sum of matrices."""
    all_cells = parts[0].select("i", "j", "x")
    for p in parts[1:]:
        all_cells = all_cells.unionByName(p.select("i", "j", "x"))
    return all_cells.groupBy("i", "j").agg(F.sum("x").alias("x"))


def identity(codes: DataFrame, code: str = "i") -> DataFrame:
    """The unit matrix over a list of codes."""
    return codes.select(F.col(code).alias("i"), F.col(code).alias("j"), F.lit(1.0).alias("x")).distinct()


def same_codes(a: DataFrame, b: DataFrame, code: str) -> None:
    """Raise ValueError if one list has a code that the other lacks."""
    left, right = a.select(code).distinct(), b.select(code).distinct()
    odd = [r[0] for r in left.join(right, code, "left_anti").union(right.join(left, code, "left_anti")).limit(5).collect()]
    if odd:
        raise ValueError(f"codes that only one side has: {odd}")


def technical_coefficients(flows: DataFrame, output: DataFrame | None = None) -> DataFrame:
    """Flows by the output of their column. output: j, x; by default twice the column's sum, so all columns sum to a half."""
    sums = flows.groupBy("j").agg((F.sum("x") * 2).alias("out")) if output is None else output.select("j", F.col("x").alias("out"))
    return flows.join(F.broadcast(sums), "j").select("i", "j", ratio(F.col("x"), F.col("out")).alias("x")).filter(F.col("x").isNotNull())


def market_shares(made: DataFrame) -> DataFrame:
    """D: what each sector (i) makes of a product (j), as a share of all that is made of it; products that nobody makes are left out."""
    sums = made.groupBy("j").agg(F.sum("x").alias("out"))
    return made.join(sums, "j").select("i", "j", ratio(F.col("x"), F.col("out")).alias("x")).filter(F.col("x").isNotNull())


def checked_demand(demand: DataFrame, totals: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """demand(i, j, x), a column for each component, if every row sums to totals(i, total) up to `tolerance` of it; else ValueError."""
    sums = demand.groupBy("i").agg(F.sum("x").alias("s")).join(totals, "i", "full")
    s, total_ = F.coalesce("s", F.lit(0.0)), F.coalesce("total", F.lit(0.0))
    odd = [r[0] for r in sums.filter(F.abs(s - total_) > F.lit(tolerance) * F.greatest(F.abs(total_), F.lit(1.0))).select("i").orderBy("i").limit(5).collect()]
    if odd:
        raise ValueError(f"rows whose components don't sum to their total: {odd}")
    return demand


def leontief_series(a: DataFrame, codes: DataFrame, terms: int) -> DataFrame:
    """I + A + ... + A^terms: the inverse of I - A up to the next power, for matrices of any size."""
    power, parts = a, [identity(codes), a]
    for k in range(2, terms + 1):
        power = product(power, a)
        if k % 4 == 0:
            power = cut(power)
        parts.append(power)
    return total(*parts[: terms + 1])


def leontief_converged(a: DataFrame, codes: DataFrame, tolerance: float = 1e-12, max_doublings: int = 30) -> DataFrame:
    """The series until the largest column sum of its last power is within tolerance, for matrices of any size.

    Each round doubles the number of terms: the first 2n are S + A^n S. Raises RuntimeError where the powers don't vanish, as then the series has no sum.
    """
    power, series = cut(a.select("i", "j", "x")), cut(total(identity(codes), a))
    for _ in range(max_doublings):
        power = cut(product(power, power))
        series = cut(total(series, product(power, series)))
        largest = power.groupBy("j").agg(F.sum(F.abs("x")).alias("s")).agg(F.max("s")).first()[0] or 0.0
        if largest <= tolerance:
            return series
        if not largest < 1e100:
            break
    raise RuntimeError("the powers of the matrix don't vanish: the series has no sum")


def leontief_inverse(a: DataFrame, codes: list[str]) -> DataFrame:
    """The exact inverse of I - A for a list of sectors small enough for one task: a national table has below a thousand.

    The matrix is inverted in a worker, not on the driver; codes fix its order. Beyond 4,000 sectors the series of leontief_converged is taken, to 1e-12.
    """

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        at = {c: k for k, c in enumerate(codes)}
        dense = np.eye(len(codes))
        np.subtract.at(dense, (pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()), pdf["x"].to_numpy())
        inverse = np.linalg.inv(dense)
        return pd.DataFrame({"i": np.repeat(codes, len(codes)), "j": np.tile(codes, len(codes)), "x": inverse.ravel()})

    if len(codes) > 4000:
        return leontief_converged(a, a.sparkSession.createDataFrame([(c,) for c in codes], "i string"))
    return a.select("i", "j", "x", F.lit(1).alias("one")).groupBy("one").applyInPandas(invert, "i string, j string, x double")


def linkages(leontief: DataFrame, codes: DataFrame) -> DataFrame:
    """Forward and backward linkages, row and column means against the grand mean, and the sector's type (L03, L04, A24). Missing cells count as 0."""
    n = codes.agg(F.count("*").cast("double").alias("n"))
    rows, columns = leontief.groupBy("i").agg(F.sum("x").alias("r")), leontief.groupBy(F.col("j").alias("i")).agg(F.sum("x").alias("c"))
    grand = leontief.agg(F.sum("x").alias("s"))
    joined = codes.select(F.col("i")).join(rows, "i", "left").join(columns, "i", "left").na.fill(0.0).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(grand))
    # (r / n) / (s / n^2) is r * n / s.
    linked = joined.select("i", ratio(F.col("r") * F.col("n"), F.col("s")).alias("forward_linkage"), ratio(F.col("c") * F.col("n"), F.col("s")).alias("backward_linkage"))
    return linked.withColumn("sector_type", sector_type(F.col("forward_linkage"), F.col("backward_linkage")))


def sector_type(forward: Column, backward: Column) -> Column:
    """I independent, II dependent on demand, III key, IV dependent on supply; 1 counts as high."""
    f, b = forward >= 1, backward >= 1
    return F.when(f & b, "III").when(f, "II").when(b, "IV").otherwise("I")


def shock(leontief: DataFrame, delta: DataFrame) -> DataFrame:
    """(scenario, i, direct, total, indirect) of demand shocks delta(scenario, j, x): L times each, all scenarios at once.

    Shocks may name the same sector twice; they add up. Sectors that no shock reaches are left out.
    """
    asked = delta.groupBy("scenario", "j").agg(F.sum("x").alias("d"))
    moved = leontief.join(F.broadcast(asked), "j").groupBy("scenario", "i").agg(F.sum(F.col("x") * F.col("d")).alias("total"))
    return moved.join(asked.withColumnRenamed("j", "i"), ["scenario", "i"], "left").select("scenario", "i", F.coalesce("d", F.lit(0.0)).alias("direct"), "total", (F.col("total") - F.coalesce("d", F.lit(0.0))).alias("indirect"))


def compare_scenarios(shocked: DataFrame) -> DataFrame:
    """Totals, multiplier and indirect share of each scenario; NULL where nothing was asked."""
    summed = shocked.groupBy("scenario").agg(F.sum("direct").alias("direct"), F.sum("total").alias("total"), F.sum("indirect").alias("indirect"))
    return summed.withColumns({"multiplier": ratio(F.col("total"), F.col("direct")), "indirect_share": ratio(F.col("indirect"), F.col("total"))})


def sector_shock(scenario: str, codes: DataFrame, chosen: str, amount: float) -> DataFrame:
    """All of the amount on one sector."""
    return codes.filter(F.col("i") == chosen).select(F.lit(scenario).alias("scenario"), F.col("i").alias("j"), F.lit(float(amount)).alias("x"))


def percentage_shock(scenario: str, demand: DataFrame, rate: float) -> DataFrame:
    """A share of each sector's final demand(i, x)."""
    return demand.select(F.lit(scenario).alias("scenario"), F.col("i").alias("j"), (F.col("x") * F.lit(rate)).alias("x"))


def rescaled(delta: DataFrame, amount: float) -> DataFrame:
    """The same shock scaled to a total; nothing comes out where the total was 0."""
    sums = delta.groupBy("scenario").agg(F.sum("x").alias("s"))
    return delta.join(F.broadcast(sums), "scenario").select("scenario", "j", ratio(F.col("x") * F.lit(float(amount)), F.col("s")).alias("x")).filter(F.col("x").isNotNull())


def compare(a: DataFrame, b: DataFrame, atol: float = 1e-8) -> DataFrame:
    """Largest and mean absolute difference, root mean square and whether all are within atol; missing cells are 0."""
    both = a.select("i", "j", F.col("x").alias("xa")).join(b.select("i", "j", F.col("x").alias("xb")), ["i", "j"], "full")
    d = F.abs(F.coalesce("xa", F.lit(0.0)) - F.coalesce("xb", F.lit(0.0)))
    return both.select(d.alias("d")).agg(F.max("d").alias("max_abs"), F.avg("d").alias("mean_abs"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.max((F.col("d") > atol).cast("int")).alias("over")).select("max_abs", "mean_abs", "rmse", (F.col("over") == 0).alias("all_close"))


def wide(cells: DataFrame, codes: list[str]) -> DataFrame:
    """Rows with one column per code, for export; the codes are given, so no pass looks for them."""
    return cells.groupBy("i").pivot("j", codes).agg(F.first("x")).na.fill(0.0)
