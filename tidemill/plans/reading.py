"""Queries behind charts and dashboards, and single-operator queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.dates import month_start
from tidemill.functions.maths import percent, ratio, rounded
from tidemill.operators import reads as V
from tidemill.operators import warehouse as W
from tidemill.plans import adapters as A
from tidemill.plans import listening as L
from tidemill.plans.problems import play_sessions
from tidemill.plans.registry import Registry
from tidemill.sources.tables import Tables

R = Registry()
_P = f"WITH RECURSIVE {A.PLAYS_SQL}"
_YEARS = f"{_P}, years AS (SELECT artist_id, listening_year, count(*) AS n FROM plays GROUP BY ALL), top AS (SELECT artist_id FROM years GROUP BY 1 ORDER BY sum(n) DESC, artist_id LIMIT 10)"


def artist_year_counts(t: Tables) -> DataFrame:
    """Plays by artist and year."""
    return A.plays(t).groupBy("artist_id", "listening_year").agg(F.count("*").alias("n"))


@R.query("artists_top_other", f"{_YEARS}, shown AS (SELECT listening_year, CASE WHEN artist_id IN (SELECT artist_id FROM top) THEN artist_id ELSE 'Other' END AS artist_id, CAST(sum(n) AS BIGINT) AS n FROM years GROUP BY ALL) SELECT *, floor(n::DOUBLE / sum(n) OVER (PARTITION BY listening_year) * 1e6 + 0.5) / 1e6 AS share FROM shown")
def artists_top_other(t: Tables) -> DataFrame:
    """R01."""
    return V.with_other(artist_year_counts(t), "listening_year", "artist_id", "n", 10).withColumn("share", rounded(F.col("share")))


_GENRES_OTHER = L._GENRE("CAST(listening_year AS INTEGER)", "listening_year") + """, best AS (SELECT canonical_genre FROM genre_periods GROUP BY 1 ORDER BY sum(weighted_scrobbles) DESC, canonical_genre LIMIT 10),
shown AS (SELECT listening_year_ AS listening_year, CASE WHEN canonical_genre IN (SELECT canonical_genre FROM best) THEN canonical_genre ELSE 'Other' END AS canonical_genre, sum(weighted_scrobbles) AS w FROM genre_periods GROUP BY ALL)
SELECT listening_year, canonical_genre, floor(w * 1e6 + 0.5) / 1e6 AS weighted_scrobbles, floor(w / sum(w) OVER (PARTITION BY listening_year) * 1e6 + 0.5) / 1e6 AS share FROM shown"""


@R.query("genres_top_other", _GENRES_OTHER)
def genres_top_other(t: Tables) -> DataFrame:
    """R01 over weighted genres."""
    shown = V.with_other(W.genre_by(A.plays(t), L.weights(t), F.col("listening_year"), "listening_year").select("listening_year", "canonical_genre", "weighted_scrobbles"), "listening_year", "canonical_genre", "weighted_scrobbles", 10)
    return shown.withColumns({"weighted_scrobbles": rounded(F.col("weighted_scrobbles")), "share": rounded(F.col("share"))})


@R.query("artist_year_heatmap", f"{_YEARS}, span AS (SELECT unnest(generate_series(min(listening_year), max(listening_year))) AS listening_year FROM years) SELECT artist_id, CAST(span.listening_year AS INTEGER) AS listening_year, coalesce(n, 0) AS n FROM top CROSS JOIN span LEFT JOIN years USING (artist_id, listening_year)")
def artist_year_heatmap(t: Tables) -> DataFrame:
    """The ten top artists in every year."""
    counts = artist_year_counts(t)
    return V.dense(counts, V.top_names(counts, "artist_id", "n", 10), V.year_range(counts, "listening_year"), ["artist_id", "listening_year"], ["n"])


@R.query("artist_year_pivot", f"{_YEARS}, placed AS (SELECT artist_id, row_number() OVER (ORDER BY sum(n) DESC, artist_id) AS rank FROM years GROUP BY 1) SELECT listening_year, " + ", ".join(f"CAST(sum(n) FILTER (rank = {k}) AS BIGINT) AS artist_{k}" for k in range(1, 6)) + " FROM years JOIN placed USING (artist_id) WHERE rank <= 5 GROUP BY 1")
def artist_year_pivot(t: Tables) -> DataFrame:
    """Years as rows, the five top artists as columns by rank."""
    counts = artist_year_counts(t)
    top = V.top_names(counts, "artist_id", "n", 5)
    ranked = counts.join(F.broadcast(top), "artist_id").groupBy("artist_id").agg(F.sum("n").alias("s")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "artist_id")))
    return counts.join(F.broadcast(ranked.select("artist_id", "rank")), "artist_id").groupBy("listening_year").pivot("rank", [1, 2, 3, 4, 5]).agg(F.sum("n")).withColumnsRenamed({str(k): f"artist_{k}" for k in range(1, 6)})


@R.query("artist_peak_index", f"{_YEARS} SELECT artist_id, listening_year, n, floor(n::DOUBLE / max(n) OVER (PARTITION BY artist_id) * 1e6 + 0.5) / 1e6 AS peak_index FROM years")
def artist_peak_index(t: Tables) -> DataFrame:
    """R08."""
    return V.peak_index(artist_year_counts(t), "artist_id", "n").withColumn("peak_index", rounded(F.col("peak_index")))


@R.query("artist_year_runs", f"{_YEARS}, g AS (SELECT artist_id, listening_year, listening_year - row_number() OVER (PARTITION BY artist_id ORDER BY listening_year) AS g FROM years) SELECT artist_id, min(listening_year) AS first, max(listening_year) AS last, count(*) AS length FROM g GROUP BY artist_id, g")
def artist_year_runs(t: Tables) -> DataFrame:
    """Unbroken runs of years in which an artist was played."""
    return V.runs(artist_year_counts(t), ["artist_id"], "listening_year")


@R.query("hourly_dense", f"{_P} SELECT CAST(h AS INTEGER) AS listening_hour, count(scrobble_id) AS n FROM generate_series(0, 23) s(h) LEFT JOIN plays ON listening_hour = h GROUP BY h")
def hourly_dense(t: Tables) -> DataFrame:
    """All 24 hours."""
    hours = t.spark.range(24).select(F.col("id").cast("int").alias("listening_hour"))
    return hours.join(A.plays(t).groupBy("listening_hour").agg(F.count("*").alias("n")), "listening_hour", "left").na.fill(0, ["n"])


_KIND = "CASE WHEN weekday_iso >= 6 THEN 'weekend' ELSE 'weekday' END"


@R.query("daytype_hourly", f"{_P}, k AS (SELECT {_KIND} AS day_type, listening_hour, count(*) AS n FROM plays GROUP BY ALL), g AS (SELECT day_type, CAST(h AS INTEGER) AS listening_hour FROM (VALUES ('weekday'), ('weekend')) d(day_type), generate_series(0, 23) s(h)) SELECT day_type, listening_hour, coalesce(n, 0) AS n, floor(coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY day_type) * 1e6 + 0.5) / 1e6 AS share FROM g LEFT JOIN k USING (day_type, listening_hour)")
def daytype_hourly(t: Tables) -> DataFrame:
    """R10, D03."""
    counted = A.plays(t).groupBy(F.when(F.col("weekday_iso") >= 6, "weekend").otherwise("weekday").alias("day_type"), "listening_hour").agg(F.count("*").alias("n"))
    kinds = t.spark.createDataFrame([("weekday",), ("weekend",)], "day_type string")
    hours = t.spark.range(24).select(F.col("id").cast("int").alias("listening_hour"))
    grid = V.dense(counted, kinds, hours, ["day_type", "listening_hour"], ["n"])
    return grid.withColumn("share", rounded(ratio(F.col("n"), F.sum("n").over(Window.partitionBy("day_type")))))


@R.query("hourly_by_full_year", f"{_P}, whole AS (SELECT listening_year FROM plays GROUP BY 1 HAVING count(DISTINCT listening_month) = 12 AND count(*) >= 500), k AS (SELECT listening_year, listening_hour, count(*) AS n FROM plays WHERE listening_year IN (SELECT listening_year FROM whole) GROUP BY ALL) SELECT listening_year, CAST(h AS INTEGER) AS listening_hour, coalesce(n, 0) AS n FROM whole CROSS JOIN generate_series(0, 23) s(h) LEFT JOIN k ON k.listening_year = whole.listening_year AND k.listening_hour = h".replace("SELECT listening_year, CAST(h", "SELECT whole.listening_year, CAST(h"))
def hourly_by_full_year(t: Tables) -> DataFrame:
    """Hours of years that are whole and busy enough."""
    plays = A.plays(t)
    whole = plays.groupBy("listening_year").agg(F.count_distinct("listening_month").alias("m"), F.count("*").alias("c")).filter("m = 12 AND c >= 500").select("listening_year")
    counted = plays.join(F.broadcast(whole), "listening_year", "left_semi").groupBy("listening_year", "listening_hour").agg(F.count("*").alias("n"))
    return V.dense(counted, whole, t.spark.range(24).select(F.col("id").cast("int").alias("listening_hour")), ["listening_year", "listening_hour"], ["n"])


_SESSIONS = """WITH once AS (SELECT user_name, scrobble_id, min(scrobbled_at_local) AS t FROM fact_scrobble WHERE scrobbled_at_local IS NOT NULL AND scrobble_id IS NOT NULL GROUP BY ALL),
f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM once WINDOW w AS (PARTITION BY user_name ORDER BY t, scrobble_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_name ORDER BY t, scrobble_id ROWS UNBOUNDED PRECEDING) AS no FROM f),
sessions AS (SELECT user_name, no, count(*) AS n, (epoch_us(max(t)) - epoch_us(min(t))) / 6e7 AS minutes FROM g GROUP BY ALL)"""
_EDGES, _LABELS = [1, 2, 5, 10, 20, 50], ["1", "2", "3-5", "6-10", "11-20", "21-50", "51+"]
_CASE = "CASE " + " ".join(f"WHEN n <= {e} THEN '{x}'" for e, x in zip(_EDGES, _LABELS)) + " ELSE '51+' END"


@R.query("session_size_hist", f"{_SESSIONS}, c AS (SELECT {_CASE} AS bucket, count(*) AS n FROM sessions GROUP BY 1), e AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(_LABELS)) + ") v(ord, bucket)) SELECT ord, bucket, coalesce(n, 0) AS n, floor(100.0::DOUBLE * (coalesce(n, 0)::DOUBLE / (sum(coalesce(n, 0)) OVER ())::DOUBLE) * 1e4 + 0.5) / 1e4 AS share_pct FROM e LEFT JOIN c USING (bucket)")
def session_size_hist(t: Tables) -> DataFrame:
    """R12, A25."""
    return V.histogram(play_sessions(t), "scrobble_count", _EDGES, _LABELS)


@R.query("session_ecdf", f"{_SESSIONS}, c AS (SELECT n AS scrobble_count, count(*) AS n FROM sessions GROUP BY 1) SELECT scrobble_count, n, floor(sum(n) OVER (ORDER BY scrobble_count ROWS UNBOUNDED PRECEDING)::DOUBLE / (SELECT count(*) FROM sessions) * 1e6 + 0.5) / 1e6 AS ecdf FROM c")
def session_ecdf(t: Tables) -> DataFrame:
    """W13."""
    return V.ecdf(play_sessions(t), "scrobble_count").withColumn("ecdf", rounded(F.col("ecdf")))


@R.query("session_medians", f"{_SESSIONS} SELECT user_name, count(*) AS sessions, median(n) AS median_plays, floor(median(minutes) * 1e6 + 0.5) / 1e6 AS median_minutes, floor(avg(n) * 1e6 + 0.5) / 1e6 AS mean_plays FROM sessions GROUP BY user_name")
def session_medians(t: Tables) -> DataFrame:
    """R22, A22, A23."""
    minutes = F.col("duration_seconds") / 60.0
    return play_sessions(t).groupBy("user_name").agg(F.count("*").alias("sessions"), F.median("scrobble_count").alias("median_plays"), rounded(F.median(minutes)).alias("median_minutes"), rounded(F.avg("scrobble_count")).alias("mean_plays"))


@R.query("session_density", f"{_SESSIONS} SELECT CAST(floor(log10(n::DOUBLE) * 4) AS BIGINT) AS x_bin, CAST(floor(log10(minutes) * 4) AS BIGINT) AS y_bin, count(*) AS n FROM sessions WHERE minutes > 0 GROUP BY ALL".replace("log10(minutes)", "log10(minutes)"))
def session_density(t: Tables) -> DataFrame:
    """R27."""
    return V.density(play_sessions(t).withColumn("minutes", (F.col("duration_seconds") * 1e6) / 6e7), "scrobble_count", "minutes")


@R.query("discovery_dense", f"{L._DISCOVERY}, span AS (SELECT CAST(unnest(generate_series(min(month_start)::TIMESTAMP, max(month_start)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month_start FROM discovery) SELECT month_start, CASE WHEN month_start = (SELECT min(month_start) FROM span) THEN NULL ELSE coalesce(new_artists, 0) END AS new_artists, coalesce(active_artists, 0) AS active_artists FROM span LEFT JOIN discovery USING (month_start)", dates=("month_start",))
def discovery_dense(t: Tables) -> DataFrame:
    """Every month; the first one can't tell new from known."""
    found = W.monthly_discovery(A.plays(t)).select("month_start", "new_artists", "active_artists")
    span = V.month_range(found, "month_start")
    whole = span.join(found, "month_start", "left").na.fill(0, ["new_artists", "active_artists"]).crossJoin(F.broadcast(span.agg(F.min("month_start").alias("opening"))))
    return whole.select("month_start", F.when(F.col("month_start") != F.col("opening"), F.col("new_artists")).alias("new_artists"), "active_artists")


@R.query("discovery_year_end", f"{L._DISCOVERY} SELECT year(month_start)::INTEGER AS year, month_start, cumulative_artists FROM discovery QUALIFY row_number() OVER (PARTITION BY year(month_start) ORDER BY month_start DESC) = 1", dates=("month_start",))
def discovery_year_end(t: Tables) -> DataFrame:
    """R15, W12."""
    return V.last_of_year(W.monthly_discovery(A.plays(t)).select("month_start", "cumulative_artists"), "month_start").select("year", "month_start", "cumulative_artists")


@R.query("discovery_outliers", f"{L._DISCOVERY} SELECT month_start, new_artists, active_artists, abs(new_artists - (SELECT median(new_artists) FROM discovery)) + abs(active_artists - (SELECT median(active_artists) FROM discovery)) AS deviation FROM discovery ORDER BY deviation DESC, month_start LIMIT 8", dates=("month_start",))
def discovery_outliers(t: Tables) -> DataFrame:
    """R16, O05."""
    return V.outliers(W.monthly_discovery(A.plays(t)).select("month_start", "new_artists", "active_artists"), ["new_artists", "active_artists"], 8, "month_start")


@R.query("overview", f"{_P} SELECT count(*) AS plays, count(DISTINCT artist_id) AS artists, count(DISTINCT track_id) AS tracks, count(DISTINCT album_id) AS albums, count(DISTINCT listening_date) AS days, min(listening_date) AS first_date, max(listening_date) AS last_date FROM plays", dates=("first_date", "last_date"))
def overview(t: Tables) -> DataFrame:
    """R17, A02."""
    return A.plays(t).agg(F.count("*").alias("plays"), *[F.count_distinct(f"{c}_id").alias(f"{c}s") for c in ("artist", "track", "album")], F.count_distinct("listening_date").alias("days"), F.min("listening_date").alias("first_date"), F.max("listening_date").alias("last_date"))


@R.query("rank_window", f"{_YEARS} SELECT artist_id, CAST(sum(n) AS BIGINT) AS n FROM years WHERE listening_year BETWEEN 2020 AND 2021 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def rank_window(t: Tables) -> DataFrame:
    """The top of a span of years."""
    return artist_year_counts(t).filter(F.col("listening_year").between(2020, 2021)).groupBy("artist_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "artist_id").limit(15)


@R.query("weekday_hour_matrix", f"{_P} SELECT weekday_iso, " + ", ".join(f"count(*) FILTER (listening_hour = {h}) AS h{h}" for h in range(24)) + " FROM plays GROUP BY 1")
def weekday_hour_matrix(t: Tables) -> DataFrame:
    """R21, C07."""
    return A.plays(t).groupBy("weekday_iso").pivot("listening_hour", list(range(24))).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({str(h): f"h{h}" for h in range(24)})


@R.query("metrics_long", f"{_P}, o AS (SELECT count(*) AS plays, count(DISTINCT artist_id) AS artists, count(DISTINCT track_id) AS tracks FROM plays) UNPIVOT o ON plays, artists, tracks INTO NAME metric VALUE value")
def metrics_long(t: Tables) -> DataFrame:
    """One row per metric."""
    return overview(t).unpivot([], ["plays", "artists", "tracks"], "metric", "value")


# Single operators over the order tables.


@R.query("join_band", "SELECT o_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def join_band(t: Tables) -> DataFrame:
    """J03."""
    near = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 day"))
    return t.orders.join(t.lineitem, (F.col("o_orderkey") == F.col("l_orderkey")) & near).select("o_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@R.query("join_anti_semi", "SELECT 'without' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'with', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_anti_semi(t: Tables) -> DataFrame:
    """J10, J11."""
    on = F.col("c_custkey") == F.col("o_custkey")
    count = lambda how, kind: t.customer.join(t.orders, on, how).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("left_anti", "without").unionByName(count("left_semi", "with"))


@R.query("join_left_star", "SELECT r_name, n_name, count(c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN (SELECT c_nationkey, c_custkey FROM customer) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey GROUP BY ALL")
def join_left_star(t: Tables) -> DataFrame:
    """A chain of left joins; sides are aggregated first, so none multiplies another."""
    customers = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("k2")).agg(F.lit(1).alias("suppliers"))
    star = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"), "left").join(customers, F.col("n_nationkey") == F.col("k"), "left").join(suppliers, F.col("n_nationkey") == F.col("k2"), "left")
    return star.select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))


@R.query("agg_filter", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS discounted, floor(sum(l_extendedprice) FILTER (l_quantity > 25) * 100 + 0.5) / 100 AS bulk, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT date_trunc('month', l_shipdate)) AS months FROM lineitem GROUP BY ALL")
def agg_filter(t: Tables) -> DataFrame:
    """A04, A05, A06."""
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), rounded(F.sum(F.when(F.col("l_quantity") > 25, F.col("l_extendedprice"))), 2).alias("bulk"),
        F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct(month_start(F.col("l_shipdate"))).alias("months"),
    )


@R.query("agg_argmax", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1")
def agg_argmax(t: Tables) -> DataFrame:
    """A08, A10."""
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))


@R.query("quantiles", "SELECT event_type, floor(quantile_cont(value, 0.25) * 1e6 + 0.5) / 1e6 AS q25, floor(median(value) * 1e6 + 0.5) / 1e6 AS q50, floor(quantile_cont(value, 0.9) * 1e6 + 0.5) / 1e6 AS q90 FROM events GROUP BY 1")
def quantiles(t: Tables) -> DataFrame:
    """A22."""
    return t.events.groupBy("event_type").agg(*[rounded(F.percentile("value", q)).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.9, "q90"))])


@R.query("win_lag_rank", "SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days_since, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS price_rank, floor(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) * 100 + 0.5) / 100 AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)".replace("(w ROWS UNBOUNDED PRECEDING)", "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"))
def win_lag_rank(t: Tables) -> DataFrame:
    """W05, W07, W08."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    dear = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return t.orders.select("o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("days_since"), F.rank().over(dear).cast("long").alias("price_rank"), rounded(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@R.query("win_share_total", "SELECT c_mktsegment, count(*) AS n, floor(100.0::DOUBLE * (count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE) * 1e4 + 0.5) / 1e4 AS share_pct FROM customer GROUP BY 1")
def win_share_total(t: Tables) -> DataFrame:
    """The share is over the few groups, not over rows."""
    counted = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return counted.withColumn("share_pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


@R.query("dedupe_keep_first", "SELECT * EXCLUDE r FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def dedupe_keep_first(t: Tables) -> DataFrame:
    """Min over a struct is reduced before the shuffle, which row_number isn't."""
    first = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("f"))
    return first.select("l_orderkey", "l_linenumber", "f.l_partkey", "f.l_suppkey")


@R.query("set_operations", "SELECT 'either' AS kind, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL SELECT 'both', count(*) FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT 'rows', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer)")
def set_operations(t: Tables) -> DataFrame:
    """U01, U02, U04."""
    a, b = t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k"))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.union(b).distinct(), "either").unionByName(count(a.intersect(b), "both")).unionByName(count(a.unionByName(b), "rows"))


@R.query("cross_bounds", "SELECT p_partkey, floor((p_retailprice - b.lo) / nullif(b.hi - b.lo, 0) * 1e6 + 0.5) / 1e6 AS place FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) b")
def cross_bounds(t: Tables) -> DataFrame:
    """One row of bounds beside every row."""
    bounds = t.part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return t.part.crossJoin(F.broadcast(bounds)).select("p_partkey", rounded(ratio(F.col("p_retailprice") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("place"))
