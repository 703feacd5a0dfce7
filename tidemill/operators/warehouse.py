"""The listening warehouse: staging, dimensions, fact, genre and release bridges, and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.dates import decade, local_time, month_start, season_name, season_order, season_year
from tidemill.functions.maths import percent, ratio, rounded
from tidemill.functions.text import blank_to_null, lower_key, md5_key
from tidemill.operators.delivery import PLAY_ORDER, deliver_once, historical_plays, play_identifier

#: Columns of a play that its repeated copies agree in.
PLAY = ["scrobble_id", "user_name", "artist_id", "track_id", "album_id", "scrobbled_at_local", "listening_date", "listening_year", "listening_month", "listening_hour", "weekday_iso", "weekday_name"]

count_if = lambda c: F.count_if(c)


def stage_plays(bronze: DataFrame) -> DataFrame:
    """One row per play of a user: trimmed texts, their keys, blank ids as NULL; the copy ingested first stays.

    scrobble_id doesn't tell users apart, as it is the key of one user's warehouse; play_id does, and is unique.
    """
    once = deliver_once(historical_plays(bronze), play_identifier(), PLAY_ORDER, "observation_id")
    keyed = once.withColumns({"artist_norm": F.lower(F.trim("artist")), "track_norm": F.lower(F.trim("track")), "album_norm": lower_key(F.col("album"))})
    return keyed.select(
        md5_key(F.col("scrobbled_at_uts").cast("string"), F.col("artist_norm"), F.col("track_norm"), F.coalesce("album_norm", F.lit(""))).alias("scrobble_id"),
        F.md5(F.to_json(F.struct("user_name", "scrobbled_at_uts", "artist_norm", "track_norm", "album_norm"))).alias("play_id"),
        "user_name", F.trim("artist").alias("artist"), F.trim("track").alias("track"), blank_to_null(F.col("album")).alias("album"), "artist_norm", "track_norm", "album_norm",
        *[blank_to_null(F.col(c)).alias(c) for c in ("artist_mbid", "track_mbid", "album_mbid")],
        "scrobbled_at", "scrobbled_at_uts", "track_url", F.col("run_id").alias("source_run_id"), "source_page", "source_position", "source_file", "ingested_at",
    )


def latest_text(value: str, at: str = "scrobbled_at_uts") -> Column:
    """The non-NULL value with the latest time, then the larger text."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(at, value)))


def dimension(staged: DataFrame, keys: list[str], name: str, mbid: str, key_name: str, *more: Column) -> DataFrame:
    """One row per combination of keys: MD5 key, latest name, largest mbid, first and latest time, plays (Q02-Q04)."""
    grouped = staged.groupBy(*keys).agg(
        latest_text(name).alias(f"{name}_name"), F.max(mbid).alias(mbid), F.min("scrobbled_at").alias("first_scrobble_at"), F.max("scrobbled_at").alias("latest_scrobble_at"), F.count("*").alias("scrobble_count"), *more
    )
    ids = [md5_key(*map(F.col, keys)).alias(key_name)] + ([md5_key(F.col("artist_norm")).alias("artist_id")] if key_name != "artist_id" else [])
    return grouped.select(*ids, "*")


def dim_artist(staged: DataFrame) -> DataFrame:
    """Artists (Q02)."""
    return dimension(staged, ["artist_norm"], "artist", "artist_mbid", "artist_id")


def dim_album(staged: DataFrame) -> DataFrame:
    """Albums; plays without one are left out (Q03)."""
    return dimension(staged.filter(F.col("album_norm").isNotNull()), ["artist_norm", "album_norm"], "album", "album_mbid", "album_id")


def dim_track(staged: DataFrame) -> DataFrame:
    """Tracks with their number of albums (Q04)."""
    return dimension(staged, ["artist_norm", "track_norm"], "track", "track_mbid", "track_id", F.count_distinct("album_norm").alias("album_count"))


def fact_plays(staged: DataFrame, zone: str = "America/Sao_Paulo") -> DataFrame:
    """Plays with dimension keys and local calendar columns."""
    local = staged.withColumn("scrobbled_at_local", local_time(F.col("scrobbled_at"), zone))
    at = F.col("scrobbled_at_local")
    return local.select(
        "scrobble_id", "user_name", md5_key(F.col("artist_norm")).alias("artist_id"), md5_key(F.col("artist_norm"), F.col("track_norm")).alias("track_id"),
        F.when(F.col("album_norm").isNotNull(), md5_key(F.col("artist_norm"), F.col("album_norm"))).alias("album_id"), F.col("scrobbled_at").cast("timestamp_ntz").alias("scrobbled_at_utc"), "scrobbled_at_local",
        at.cast("date").alias("listening_date"), F.year(at).alias("listening_year"), F.month(at).alias("listening_month"), F.hour(at).alias("listening_hour"),
        F.weekday(at).cast("int").__add__(1).alias("weekday_iso"), F.date_format(at, "EEEE").alias("weekday_name"), "source_run_id", "source_page", "source_position",
    )


def plays_once(fact: DataFrame) -> DataFrame:
    """Rows of the fact written again count once; plays without a local time are left out."""
    return fact.filter(F.col("listening_date").isNotNull()).select(*PLAY).distinct()


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys of the fact that the dimension lacks."""
    return fact.filter(F.col(key).isNotNull()).select(key).distinct().join(dim, key, "left_anti")


def build_metrics(bronze: DataFrame, staged: DataFrame) -> DataFrame:
    """One row of counts over bronze and staging."""
    playing = F.coalesce(F.col("is_now_playing"), F.lit(False))
    raw = bronze.agg(F.count("*").alias("bronze_rows"), count_if(playing).alias("now_playing_rows"), count_if(~playing & F.col("scrobbled_at_uts").isNotNull()).alias("historical_rows"), F.count_distinct("run_id").alias("runs"))
    return raw.crossJoin(F.broadcast(staged.agg(F.count("*").alias("unique_plays")))).withColumn("removed_copies", F.col("historical_rows") - F.col("unique_plays"))


def _distinct(*names: str) -> list[Column]:
    return [F.count_distinct(f"{n}_id").alias(f"distinct_{n}s") for n in names]


def daily_listening(plays: DataFrame) -> DataFrame:
    """Plays and variety of each day (Q08)."""
    return plays.groupBy("listening_date").agg(
        F.count("*").alias("scrobble_count"), *_distinct("artist", "track", "album"), F.count_distinct("listening_hour").alias("active_hours"), F.min("scrobbled_at_local").alias("first_scrobble_at_local"), F.max("scrobbled_at_local").alias("latest_scrobble_at_local")
    )


def artist_summary(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Recency, variety and share of each artist."""
    activity = plays.groupBy("artist_id").agg(
        F.count("*").alias("scrobble_count"), *_distinct("track", "album"), F.count_distinct("listening_date").alias("active_days"), F.count_distinct(month_start(F.col("listening_date"))).alias("active_months"),
        F.min("scrobbled_at_local").alias("first_scrobble_at_local"), F.max("scrobbled_at_local").alias("latest_scrobble_at_local"),
    )
    bounds = plays.agg(F.count("*").alias("total"), F.max("listening_date").alias("latest"))
    joined = activity.join(artists, "artist_id").crossJoin(F.broadcast(bounds))
    return joined.withColumns({"days_since_last_scrobble": F.datediff("latest", F.col("latest_scrobble_at_local").cast("date")).cast("long"), "scrobble_share_pct": percent(F.col("scrobble_count"), F.col("total"))}).drop("total", "latest")


def by_hour(plays: DataFrame, extra: list[str], share_within: list[str], share_name: str) -> DataFrame:
    """Plays of each weekday and hour (and extra keys): per active day, and as a share of all or within a group."""
    hourly = plays.groupBy(*extra, "weekday_iso", "weekday_name", "listening_hour").agg(F.count("*").alias("scrobble_count"), F.count_distinct("listening_date").alias("active_days"))
    # The shares are over a few thousand aggregated rows.
    total = F.sum("scrobble_count").over(Window.partitionBy(*(share_within or [F.lit(1)])))
    return hourly.withColumns({"avg_scrobbles_per_active_day": rounded(ratio(F.col("scrobble_count"), F.col("active_days")), 2), share_name: percent(F.col("scrobble_count"), total)})


def with_season(plays: DataFrame) -> DataFrame:
    """plays with month_start, season_year, season_order and season_name."""
    year, month = F.year("listening_date"), F.month("listening_date")
    return plays.withColumns({"month_start": month_start(F.col("listening_date")), "season_year": season_year(year, month), "season_order": season_order(month)}).withColumn("season_name", season_name(F.col("season_order")))


def monthly_discovery(plays: DataFrame) -> DataFrame:
    """New and returning artists of each month, and how many were known so far."""
    monthly = plays.groupBy(month_start(F.col("listening_date")).alias("month_start"), "artist_id").agg(F.count("*").alias("n"))
    first = monthly.groupBy("artist_id").agg(F.min("month_start").alias("first_month"))
    new = F.col("first_month") == F.col("month_start")
    summed = monthly.join(first, "artist_id").groupBy("month_start").agg(
        F.sum("n").alias("scrobble_count"), F.count("*").alias("active_artists"), count_if(new).alias("new_artists"), F.coalesce(F.sum(F.when(new, F.col("n"))), F.lit(0)).alias("new_artist_scrobbles")
    )
    # One row a month: the running sum is over the calendar, not over plays.
    upto = Window.orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    return summed.withColumns(
        {
            "returning_artists": F.col("active_artists") - F.col("new_artists"),
            "cumulative_artists": F.sum("new_artists").over(upto),
            "discovery_rate_pct": percent(F.col("new_artists"), F.col("active_artists"), 2),
            "new_artist_scrobble_share_pct": percent(F.col("new_artist_scrobbles"), F.col("scrobble_count"), 2),
        }
    )


def tag_evidence(albums: DataFrame, album_tags: DataFrame, artist_tags: DataFrame) -> DataFrame:
    """Tags of each album, or of its artist where it has none."""
    tag = ["tag_rank", "tag_norm", "tag_weight"]
    own = albums.join(album_tags, "album_id").select("album_id", "artist_id", *tag, F.lit("album").alias("tag_source"))
    lacking = albums.join(album_tags.select("album_id").distinct(), "album_id", "left_anti")
    return own.unionByName(lacking.join(artist_tags, "artist_id").select("album_id", "artist_id", *tag, F.lit("artist_fallback").alias("tag_source")))


def genre_weights(evidence: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Weight of each canonical genre in an album: the largest of its tags, normalised to 1 per album, ranked."""
    genres = taxonomy.filter((F.col("tag_type") == "genre") & F.col("canonical_genre").isNotNull()).select("tag_norm", "canonical_genre")
    raw = evidence.filter("tag_weight > 0").join(genres, "tag_norm").groupBy("album_id", "artist_id", "tag_source", "canonical_genre").agg(F.max("tag_weight").alias("genre_weight_raw"), F.count_distinct("tag_norm").alias("source_tag_count"))
    weighted = raw.withColumn("genre_weight", F.col("genre_weight_raw").cast("double") / F.sum("genre_weight_raw").over(Window.partitionBy("album_id")))
    return weighted.withColumn("genre_rank", F.row_number().over(Window.partitionBy("album_id").orderBy(F.desc("genre_weight"), "canonical_genre")).cast("long"))


def genre_by(plays: DataFrame, weights: DataFrame, period: Column, name: str) -> DataFrame:
    """Weighted plays, share and coverage of genres in each period."""
    timed = plays.withColumn(name, period)
    whole = timed.groupBy(name).agg(F.count("*").alias("total_scrobbles"), F.count("album_id").alias("scrobbles_with_album"), F.count_distinct("listening_date").alias("active_days"))
    # A play is covered if its album has any genre: a semi-join, no distinct over the weighted rows.
    covered = timed.join(weights.select("album_id").distinct(), "album_id", "left_semi").groupBy(name).agg(F.count("*").alias("genre_covered_scrobbles"))
    per_album = timed.filter(F.col("album_id").isNotNull()).groupBy(name, "album_id").agg(F.count("*").alias("n"))
    genre = per_album.join(weights, "album_id").groupBy(name, "canonical_genre").agg(
        F.sum(F.col("n") * F.col("genre_weight")).alias("weighted_scrobbles"), F.count_distinct("album_id").alias("active_albums"), F.count_distinct("artist_id").alias("active_artists")
    )
    shared = genre.withColumn("genre_share", F.col("weighted_scrobbles") / F.sum("weighted_scrobbles").over(Window.partitionBy(name)))
    return shared.join(covered, name).join(whole, name).withColumn("genre_coverage", ratio(F.col("genre_covered_scrobbles"), F.col("total_scrobbles")))


def genre_seasonality(monthly: DataFrame, weights: DataFrame, latest_month: DataFrame) -> DataFrame:
    """Seasonal means of genre shares against their overall mean.

    monthly: genre_by months; latest_month: one row `latest`, whose month is left out as it may not be whole. Genres without plays in a month count as 0 there:
    the grid is months x genres, both of which are dimensions that don't grow with plays.
    """
    y, m = F.year("month_start"), F.month("month_start")
    whole = monthly.crossJoin(F.broadcast(latest_month)).filter(F.col("month_start") < F.col("latest"))
    months = whole.select("month_start", season_year(y, m).alias("season_year"), season_order(m).alias("season_order"), "genre_covered_scrobbles", "active_days", "genre_coverage").distinct()
    cells = monthly.select("month_start", "canonical_genre", "weighted_scrobbles", "genre_share")
    grid = months.crossJoin(F.broadcast(weights.select("canonical_genre").distinct())).join(cells, ["month_start", "canonical_genre"], "left").na.fill(0.0, ["weighted_scrobbles", "genre_share"])
    base = grid.groupBy("canonical_genre").agg(F.avg("genre_share").alias("base"))
    seasons = grid.groupBy("canonical_genre", "season_order").agg(
        F.count("*").alias("observed_months"), F.count_distinct("season_year").alias("observed_years"), F.sum("active_days").alias("total_active_days"), F.avg("genre_coverage").alias("mean_genre_coverage"),
        F.avg("genre_share").alias("mean_monthly_genre_share"), F.sum("weighted_scrobbles").alias("weighted_scrobbles"), ratio(F.sum("weighted_scrobbles"), F.sum("genre_covered_scrobbles")).alias("volume_weighted_genre_share"),
    )
    return seasons.join(base, "canonical_genre").withColumns({"season_name": season_name(F.col("season_order")), "seasonality_index": ratio(F.col("mean_monthly_genre_share"), F.col("base"))}).drop("base")


def genre_season_years(plays: DataFrame, weights: DataFrame) -> DataFrame:
    """Genres of each season of each season-year with support, shares, ranks and whether the year is whole."""
    raw = with_season(plays)
    season, year = ["season_year", "season_order"], ["season_year"]
    months = F.count_distinct("month_start")
    totals = lambda keys, p: raw.groupBy(*keys).agg(F.count("*").alias(f"{p}_total_scrobbles"), F.count_distinct("listening_date").alias(f"{p}_active_days"), months.alias("season_observed_months" if p == "season" else "months_observed_in_season_year"), *([] if p == "season" else [F.count_distinct("season_order").alias("seasons_observed_in_season_year")]))
    # Plays are counted by album first; genres are joined to these counts, not to plays.
    albums = raw.filter(F.col("album_id").isNotNull()).groupBy(*season, "album_id").agg(F.count("*").alias("n"))
    genre = albums.join(weights.select("album_id", "canonical_genre", "genre_weight"), "album_id")
    part = lambda keys, p: genre.groupBy(*keys, "canonical_genre").agg(F.sum(F.col("n") * F.col("genre_weight")).alias(f"{p}_genre_weighted_scrobbles"), F.sum("n").alias(f"{p}_genre_distinct_scrobbles"))
    known = albums.join(weights.groupBy("album_id").agg(F.sum("genre_weight").alias("w")), "album_id")
    cover = lambda keys, p: known.groupBy(*keys).agg(F.sum(F.col("n") * F.col("w")).alias(f"{p}_covered_scrobbles"), F.sum("n").alias(f"{p}_covered_distinct_scrobbles"))
    ranked = part(year, "season_year").withColumn("genre_rank_in_season_year", F.row_number().over(Window.partitionBy("season_year").orderBy(F.desc("season_year_genre_weighted_scrobbles"), "canonical_genre")).cast("long"))
    joined = part(season, "season").join(ranked, [*year, "canonical_genre"]).join(cover(season, "season"), season).join(cover(year, "season_year"), year).join(totals(season, "season"), season).join(totals(year, "season_year"), year)
    shared = joined.withColumns({"season_name": season_name(F.col("season_order")), "season_share": ratio(F.col("season_genre_weighted_scrobbles"), F.col("season_covered_scrobbles")), "season_year_share": ratio(F.col("season_year_genre_weighted_scrobbles"), F.col("season_year_covered_scrobbles"))})
    return shared.withColumns({"is_full_season_year": (F.col("months_observed_in_season_year") == 12) & (F.col("seasons_observed_in_season_year") == 4), "seasonality_index_season_year": ratio(F.col("season_share"), F.col("season_year_share"))})


def artist_lifecycle(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Span, peaks and longest silence of each artist; silence is counted in observed months."""
    monthly = plays.groupBy("artist_id", month_start(F.col("listening_date")).alias("month_start")).agg(F.count("*").alias("n"))
    # One row for each month of the calendar: its window is as small as the calendar.
    index = monthly.select("month_start").distinct().withColumn("i", F.row_number().over(Window.orderBy("month_start")).cast("long"))
    stats = plays.groupBy("artist_id").agg(
        F.count("*").alias("total_scrobbles"), F.count_distinct("listening_date").alias("active_days"), F.count_distinct("listening_year").alias("active_years"), F.min("listening_date").alias("first_observed_date"), F.max("listening_date").alias("last_observed_date")
    )
    # The earliest of equal peaks wins: min_by over (-plays, time) needs no window.
    peak = lambda df, at, p: df.groupBy("artist_id").agg(F.min_by(at, F.struct(-F.col("n"), F.col(at))).alias(p), F.max("n").alias(f"{p}_scrobbles"))
    yearly = monthly.groupBy("artist_id", F.year("month_start").alias("year")).agg(F.sum("n").alias("n"))
    placed = monthly.join(F.broadcast(index), "month_start").withColumn("gap", F.col("i") - F.lag("i").over(Window.partitionBy("artist_id").orderBy("i")) - 1)
    gaps = placed.groupBy("artist_id").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("longest_inactive_observed_months"), F.max("i").alias("last_i"), F.count("*").alias("active_months"), F.min("month_start").alias("first_observed_month"), F.max("month_start").alias("last_observed_month"))
    bounds = index.agg(F.max("i").alias("latest_i"), F.min("month_start").alias("opening"), F.max("month_start").alias("closing"))
    joined = stats.join(artists.select("artist_id", "artist_name"), "artist_id").join(peak(yearly, "year", "peak_year"), "artist_id").join(peak(monthly, "month_start", "peak_month"), "artist_id").join(gaps, "artist_id").crossJoin(F.broadcast(bounds))
    return joined.withColumns(
        {
            "observed_span_days": F.datediff("last_observed_date", "first_observed_date").cast("long"),
            "observed_months_since_last": F.col("latest_i") - F.col("last_i"),
            "first_seen_in_dataset_opening_month": F.col("first_observed_month") == F.col("opening"),
            "active_in_latest_observed_month": F.col("last_observed_month") == F.col("closing"),
        }
    ).drop("latest_i", "last_i", "opening", "closing")


def artist_yearly(plays: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Each artist's years: shares of the year and of the artist's lifetime, flags and rank (Q17)."""
    totals = plays.groupBy("listening_year").agg(F.count("*").alias("year_total_scrobbles"), F.count_distinct("listening_date").alias("dataset_active_days"))
    stats = plays.groupBy("artist_id", "listening_year").agg(F.count("*").alias("scrobbles"), F.count_distinct("listening_date").alias("active_days"), F.count_distinct("listening_month").alias("active_months"), *_distinct("track", "album"))
    life = lifecycle.select("artist_id", "artist_name", "total_scrobbles", "peak_year", F.year("first_observed_date").alias("first_year"), F.year("last_observed_date").alias("last_year"))
    year = F.col("listening_year")
    joined = stats.join(F.broadcast(totals), "listening_year").join(life, "artist_id").withColumns(
        {
            "year_scrobble_share": ratio(F.col("scrobbles"), F.col("year_total_scrobbles")),
            "artist_lifetime_share": ratio(F.col("scrobbles"), F.col("total_scrobbles")),
            "is_peak_year": year == F.col("peak_year"),
            "is_first_observed_year": year == F.col("first_year"),
            "is_last_observed_year": year == F.col("last_year"),
            "artist_rank": F.row_number().over(Window.partitionBy("listening_year").orderBy(F.desc("scrobbles"), "artist_name", "artist_id")).cast("long"),
        }
    )
    return joined.drop("total_scrobbles", "peak_year", "first_year", "last_year")


def release_years(albums: DataFrame, looked_up: DataFrame, album_tags: DataFrame, as_of_year: int) -> DataFrame:
    """Release year of each album: the one looked up, else a single year-like tag, else unknown.

    looked_up: album_id, first_release_year, resolution_method. Both sources are compared only where both are there.
    """
    year = F.expr("try_cast(tag_norm AS int)")
    tags = album_tags.filter(F.col("tag_norm").rlike("^(19|20)[0-9]{2}$") & year.between(1900, as_of_year)).groupBy("album_id").agg(F.count_distinct(year).alias("n"), F.min(year).alias("y"))
    mb = looked_up.select("album_id", F.col("first_release_year").alias("musicbrainz_release_year"), F.col("resolution_method").alias("musicbrainz_resolution_method"))
    joined = albums.select("album_id").join(mb, "album_id", "left").join(tags, "album_id", "left")
    a, b = F.col("musicbrainz_release_year"), F.col("lastfm_release_year")
    known = joined.select("album_id", "musicbrainz_release_year", "musicbrainz_resolution_method", F.coalesce("n", F.lit(0)).alias("lastfm_candidate_year_count"), F.when(F.col("n") == 1, F.col("y")).alias("lastfm_release_year"))
    both = a.isNotNull() & b.isNotNull()
    return known.withColumns(
        {
            "release_year": F.coalesce(a, b),
            "release_decade": decade(F.coalesce(a, b)),
            "release_year_source": F.when(a.isNotNull(), "musicbrainz").when(b.isNotNull(), "lastfm_year_tag").otherwise("unknown"),
            "has_release_year": a.isNotNull() | b.isNotNull(),
            "both_sources_available": both,
            "exact_year_match": F.when(both, a == b),
            "same_decade": F.when(both, decade(a) == decade(b)),
            "release_decade_conflict": F.when(both, decade(a) != decade(b)),
        }
    )


def by_decade(plays: DataFrame, releases: DataFrame, period: str | None = None) -> DataFrame:
    """Plays of each release decade (in each period) with shares of resolved, album and all plays."""
    keys = [period] if period else []
    dated = plays.join(releases.select("album_id", "release_year", "release_decade"), "album_id", "left")
    p = "year_" if period else ""
    cover = dated.groupBy(*keys).agg(
        F.count("*").alias(f"{p}total_scrobbles"), F.count("album_id").alias(f"{p}scrobbles_with_album"), F.count("release_year").alias(f"{p}release_year_covered_scrobbles"),
        count_if(F.col("album_id").isNotNull() & F.col("release_year").isNull()).alias(f"{p}release_year_unknown_scrobbles"), count_if(F.col("album_id").isNull()).alias(f"{p}scrobbles_without_album"),
        *([F.count_distinct("listening_month").alias("months_observed"), F.count_distinct("listening_date").alias("active_days"), F.min("listening_date").alias("first_listening_date"), F.max("listening_date").alias("last_listening_date")] if period else []),
    )
    stats = dated.filter(F.col("release_decade").isNotNull()).groupBy(*keys, "release_decade").agg(
        F.count("*").alias("scrobble_count"), *_distinct("track", "album", "artist"), *([] if period else [F.min("release_year").alias("earliest_release_year"), F.max("release_year").alias("latest_release_year")])
    )
    # Ranks are over decades, a dozen rows a period.
    rank = F.rank().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("scrobble_count"), "release_decade")).cast("long")
    joined = (stats.join(F.broadcast(cover), period) if period else stats.crossJoin(F.broadcast(cover))).withColumn("release_decade_label", F.concat(F.col("release_decade").cast("string"), F.lit("s")))
    n, total, album, resolved = F.col("scrobble_count"), F.col(f"{p}total_scrobbles"), F.col(f"{p}scrobbles_with_album"), F.col(f"{p}release_year_covered_scrobbles")
    shared = joined.withColumns({"release_year_coverage": ratio(resolved, album), "release_year_dataset_coverage": ratio(resolved, total)})
    if period:
        return shared.withColumns({"decade_rank_in_year": rank, "decade_share_within_resolved_year": ratio(n, resolved), "decade_share_within_full_year": ratio(n, total), "is_full_calendar_year": F.col("months_observed") == 12})
    return shared.withColumns({"decade_rank": rank, "share_of_resolved_scrobbles": ratio(n, resolved), "share_of_album_scrobbles": ratio(n, album), "share_of_all_scrobbles": ratio(n, total)})
