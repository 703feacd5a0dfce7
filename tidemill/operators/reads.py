"""Shapes that charts and dashboards ask for: top groups, dense calendars, heat maps, distributions, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.maths import percent, ratio


def top_names(df: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """The n names with the largest sum, ties by name (O03, O04): a top-k in one pass, no full sort."""
    return df.groupBy(name).agg(F.sum(value).alias("_v")).orderBy(F.desc("_v"), name).limit(n).select(name)


def with_other(df: DataFrame, period: str, name: str, value: str, n: int, other: str = "Other") -> DataFrame:
    """(period, name, value, share): the n largest names, the rest as `other`, and shares of the period."""
    top = F.broadcast(top_names(df, name, value, n).withColumn("_top", F.lit(True)))
    shown = df.join(top, name, "left").withColumn(name, F.when(F.col("_top"), F.col(name)).otherwise(other))
    summed = shown.groupBy(period, name).agg(F.sum(value).alias(value))
    return summed.withColumn("share", ratio(F.col(value), F.sum(value).over(Window.partitionBy(period))))


def dense(df: DataFrame, rows: DataFrame, columns: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every combination of two short dimensions, with 0 for values that are missing."""
    return rows.crossJoin(F.broadcast(columns)).join(df, keys, "left").na.fill(0, values)


def year_range(df: DataFrame, year: str) -> DataFrame:
    """All years from the first to the last."""
    return df.agg(F.min(year).alias("a"), F.max(year).alias("b")).select(F.explode(F.sequence("a", "b")).alias(year))


def month_range(df: DataFrame, month: str) -> DataFrame:
    """All first days of months from the first to the last."""
    return df.agg(F.min(month).alias("a"), F.max(month).alias("b")).select(F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"), F.expr("interval 1 month"))).alias(month))


def runs(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, first, last, length) of runs of consecutive whole numbers (W14, gaps and islands); repeated numbers count once."""
    island = F.col(n) - F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(n))
    return df.select(*keys, n).distinct().withColumn("_g", island).groupBy(*keys, "_g").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("length")).drop("_g")


def bucket(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge that c doesn't exceed (right-closed), the last label beyond all."""
    out = None
    for edge, label in zip(edges, labels):
        out = F.when(c <= edge, label) if out is None else out.when(c <= edge, label)
    return out.otherwise(labels[-1])


def histogram(df: DataFrame, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    """(bucket, n, share_pct) in all buckets, empty ones too."""
    counted = df.groupBy(bucket(F.col(value), edges, labels).alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(k, label) for k, label in enumerate(labels)], "ord int, bucket string")
    whole = every.join(counted, "bucket", "left").na.fill(0, ["n"])
    return whole.withColumn("share_pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, n, share of rows up to it): the distribution by distinct values, of which there are few."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = counted.agg(F.sum("n").alias("_t"))
    return counted.withColumn("_c", upto).crossJoin(F.broadcast(total)).select(value, "n", ratio(F.col("_c"), F.col("_t")).alias("ecdf"))


def peak_index(df: DataFrame, name: str, value: str) -> DataFrame:
    """value as a share of the name's largest."""
    peak = df.groupBy(name).agg(F.max(value).alias("_p"))
    return df.join(peak, name).withColumn("peak_index", ratio(F.col(value), F.col("_p"))).drop("_p")


def density(df: DataFrame, x: str, y: str, bins: int = 4) -> DataFrame:
    """(x_bin, y_bin, n): counts on a grid of log10 scale with `bins` per decade; rows without positive values are left out."""
    bin_of = lambda c: F.floor(F.log10(F.col(c).cast("double")) * bins).cast("long")
    return df.filter((F.col(x) > 0) & (F.col(y) > 0)).groupBy(bin_of(x).alias("x_bin"), bin_of(y).alias("y_bin")).agg(F.count("*").alias("n"))


def outliers(df: DataFrame, values: list[str], n: int, key: str) -> DataFrame:
    """The n rows farthest from the medians, by the sum of absolute distances."""
    middle = df.agg(*[F.median(v).alias(f"_m_{v}") for v in values])
    score = sum((F.abs(F.col(v) - F.col(f"_m_{v}")) for v in values), F.lit(0.0))
    return df.crossJoin(F.broadcast(middle)).withColumn("deviation", score).orderBy(F.desc("deviation"), key).limit(n).drop(*[f"_m_{v}" for v in values])


def last_of_year(df: DataFrame, month: str) -> DataFrame:
    """The latest row of each year."""
    latest = df.groupBy(F.year(month).alias("year")).agg(F.max(month).alias(month))
    return df.join(F.broadcast(latest), month)


def lifetime_heatmap(years: DataFrame, name: str, n: int) -> DataFrame:
    """(name, year, share) of the n names with most plays in every year from the first to the last: the share of the name's own plays, 0 in years without any.

    years: name, listening_year, scrobbles.
    """
    top = F.broadcast(top_names(years, name, "scrobbles", n))
    cells = years.join(top, name).groupBy(name, "listening_year").agg(F.sum("scrobbles").alias("scrobbles"))
    total = cells.groupBy(name).agg(F.sum("scrobbles").alias("_t"))
    whole = dense(cells, top, year_range(years, "listening_year"), [name, "listening_year"], ["scrobbles"]).join(F.broadcast(total), name)
    return whole.select(name, "listening_year", ratio(F.col("scrobbles"), F.col("_t")).alias("lifetime_share"))


def season_matrix(seasons: DataFrame, name: str, weight: str, value: str, n: int) -> DataFrame:
    """One row per name of the n with the largest weight, with the value of each season (R05). seasons: name, season_order, weight, value."""
    top = F.broadcast(top_names(seasons, name, weight, n))
    named = {"1": "summer", "2": "autumn", "3": "winter", "4": "spring"}
    return seasons.join(top, name).groupBy(name).pivot("season_order", [1, 2, 3, 4]).agg(F.first(value)).withColumnsRenamed(named)


def season_year_cells(season_years: DataFrame, n: int, least_plays: int, least_support: float, whole_only: bool) -> DataFrame:
    """(season_year, canonical_genre, season_order, shown) for the n best genres of each season-year with least_plays covered plays or more.

    shown is NULL where a genre has less than least_support weighted plays in the year: too few for a share to mean anything. whole_only: only years with all months and seasons.
    """
    kept = season_years.filter((F.col("season_year_total_scrobbles") >= least_plays) & (F.col("genre_rank_in_season_year") <= n))
    kept = kept.filter("is_full_season_year") if whole_only else kept
    shown = F.when(F.col("season_year_genre_weighted_scrobbles") >= least_support, F.col("seasonality_index_season_year"))
    return kept.select("season_year", "canonical_genre", "season_order", shown.alias("shown"))


def decade_window(yearly: DataFrame, first: int, last: int) -> DataFrame:
    """Plays, share and coverage of each release decade over the years from first to last (R19). yearly: by_decade of listening_year.

    Coverage is counted once a year, not once a decade of it; the shares are of the plays with a known decade.
    """
    window = yearly.filter(F.col("listening_year").between(first, last))
    years = window.select("listening_year", "year_release_year_covered_scrobbles", "year_total_scrobbles").distinct()
    covered = years.agg(F.sum("year_release_year_covered_scrobbles").alias("_c"), F.sum("year_total_scrobbles").alias("_t"))
    decades = window.groupBy("release_decade").agg(F.sum("scrobble_count").alias("scrobbles")).crossJoin(F.broadcast(covered))
    return decades.select("release_decade", "scrobbles", ratio(F.col("scrobbles"), F.col("_c")).alias("share"), ratio(F.col("_c"), F.col("_t")).alias("coverage"))


def ratios_by_size(df: DataFrame, size: str, parts: dict[str, str], edges: list[float], labels: list[str]) -> DataFrame:
    """(bucket, n, <name>...) of the median of each part / size by bucket of size (R13). parts: name -> column."""
    medians = [F.median(ratio(F.col(c), F.col(size))).alias(name) for name, c in parts.items()]
    return df.groupBy(bucket(F.col(size), edges, labels).alias("bucket")).agg(F.count("*").alias("n"), *medians)
