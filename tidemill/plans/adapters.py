"""Inputs that the test tables lack, derived from them by integer arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.warehouse import plays_once
from tidemill.session import cut
from tidemill.sources.tables import Tables


def draw(key: str, salt: str) -> Column:
    """A number below 2^24 from a text key: the first six hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit(salt))), 1, 6), 16, 10).cast("long")


def plays(t: Tables) -> DataFrame:
    """Each play of the fact once."""
    return t.kept.get("plays", plays_once(t.fact_scrobble))


def written_plays(t: Tables) -> DataFrame:
    """plays, written once for all steps of a query that read them several times."""
    if "plays" not in t.kept:
        t.kept["plays"] = cut(plays_once(t.fact_scrobble))
    return t.kept["plays"]


def artists(t: Tables) -> DataFrame:
    """artist_id and name, from the tracks."""
    return t.dim_track.groupBy("artist_id").agg(F.min("artist_norm").alias("artist_name"))


def genres(t: Tables) -> DataFrame:
    """Genre tags, numbered from 0 in order of their text; the list is small and fixed."""
    known = t.dim_tag_taxonomy.filter((F.col("tag_type") == "genre") & F.col("canonical_genre").isNotNull())
    return known.select("tag_norm", "canonical_genre", "tag_type", (F.row_number().over(Window.orderBy("tag_norm")) - 1).cast("long").alias("i"))


def _tags(owners: DataFrame, key: str, numbered: DataFrame, count: int, salt: str) -> DataFrame:
    drawn = owners.crossJoin(F.broadcast(numbered.agg(F.count("*").alias("n"))))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("tag_rank"), (draw(key, f"{salt}{r}") % F.col("n")).alias("i"), (draw(key, f"w{r}") % 100 + 1).alias("tag_weight")) for r in range(1, count + 1)]))
    return drawn.select(key, rows.alias("x")).select(key, "x.*").join(F.broadcast(numbered.select("tag_norm", "i")), "i").select(key, "tag_rank", "tag_norm", "tag_weight")


def album_tags(t: Tables) -> DataFrame:
    """album_id, tag_rank, tag_norm, tag_weight: three genres for four albums of five, and one or two year-like tags for some."""
    albums = t.dim_album.select("album_id").distinct()
    named = _tags(albums.filter(draw("album_id", "t") % 5 != 0), "album_id", genres(t), 3, "g")
    year = lambda salt: (draw("album_id", salt) % 70 + 1950).cast("string")
    dated = albums.filter(draw("album_id", "y") % 4 == 0).select("album_id", F.explode(F.when(draw("album_id", "y") % 8 == 0, F.array(year("yy"), year("yz"))).otherwise(F.array(year("yy")))).alias("tag_norm"))
    return named.unionByName(dated.select("album_id", F.lit(9).alias("tag_rank"), "tag_norm", F.lit(50).cast("long").alias("tag_weight")))


def artist_tags(t: Tables) -> DataFrame:
    """artist_id, tag_rank, tag_norm, tag_weight: two genres for each artist."""
    return _tags(t.dim_album.select("artist_id").distinct(), "artist_id", genres(t), 2, "a")


def looked_up_years(t: Tables) -> DataFrame:
    """album_id, first_release_year, resolution_method for one album of three."""
    albums = t.dim_album.select("album_id").distinct().filter(draw("album_id", "m") % 3 == 0)
    return albums.select("album_id", (draw("album_id", "mm") % 70 + 1950).cast("int").alias("first_release_year"), F.lit("mbid").alias("resolution_method"))


_D = lambda key, salt: f"CAST('0x' || substr(md5({key} || '{salt}'), 1, 6) AS BIGINT)"
_TAG = lambda key, salt, n: " UNION ALL ".join(f"SELECT {key}, {r} AS tag_rank, {_D(key, salt + str(r))} % (SELECT count(*) FROM genres) AS i, {_D(key, 'w' + str(r))} % 100 + 1 AS tag_weight FROM OWNERS" for r in range(1, n + 1))

PLAYS_SQL = """plays AS (SELECT DISTINCT scrobble_id, user_name, artist_id, track_id, album_id, scrobbled_at_local, listening_date, listening_year, listening_month, listening_hour, weekday_iso, weekday_name
    FROM fact_scrobble WHERE listening_date IS NOT NULL),
artists AS (SELECT artist_id, min(artist_norm) AS artist_name FROM dim_track GROUP BY artist_id)"""
TAGS_SQL = f"""genres AS (SELECT tag_norm, canonical_genre, row_number() OVER (ORDER BY tag_norm) - 1 AS i FROM dim_tag_taxonomy WHERE tag_type = 'genre' AND canonical_genre IS NOT NULL),
albums AS (SELECT DISTINCT album_id, artist_id FROM dim_album),
tagged AS (SELECT album_id FROM albums WHERE {_D('album_id', 't')} % 5 <> 0),
album_tags AS (
    SELECT album_id, tag_rank, tag_norm, tag_weight FROM ({_TAG('album_id', 'g', 3).replace('OWNERS', 'tagged')}) JOIN genres USING (i)
    UNION ALL SELECT album_id, 9, CAST({_D('album_id', 'yy')} % 70 + 1950 AS VARCHAR), 50 FROM albums WHERE {_D('album_id', 'y')} % 4 = 0
    UNION ALL SELECT album_id, 9, CAST({_D('album_id', 'yz')} % 70 + 1950 AS VARCHAR), 50 FROM albums WHERE {_D('album_id', 'y')} % 8 = 0),
tag_artists AS (SELECT DISTINCT artist_id FROM albums),
artist_tags AS (SELECT artist_id, tag_rank, tag_norm, tag_weight FROM ({_TAG('artist_id', 'a', 2).replace('OWNERS', 'tag_artists')}) JOIN genres USING (i)),
looked_up AS (SELECT album_id, CAST({_D('album_id', 'mm')} % 70 + 1950 AS INTEGER) AS first_release_year, 'mbid' AS resolution_method FROM albums WHERE {_D('album_id', 'm')} % 3 = 0),
evidence AS (
    SELECT album_id, artist_id, tag_rank, tag_norm, tag_weight, 'album' AS tag_source FROM albums JOIN album_tags USING (album_id)
    UNION ALL SELECT album_id, artist_id, tag_rank, tag_norm, tag_weight, 'artist_fallback' FROM albums JOIN artist_tags USING (artist_id) WHERE album_id NOT IN (SELECT album_id FROM album_tags)),
raw_weights AS (
    SELECT album_id, artist_id, tag_source, canonical_genre, max(tag_weight) AS genre_weight_raw, count(DISTINCT tag_norm) AS source_tag_count
    FROM evidence JOIN genres USING (tag_norm) WHERE tag_weight > 0 GROUP BY ALL),
shared_weights AS (SELECT *, CAST(genre_weight_raw AS DOUBLE) / sum(genre_weight_raw) OVER (PARTITION BY album_id) AS genre_weight FROM raw_weights),
weights AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY genre_weight DESC, canonical_genre) AS genre_rank FROM shared_weights)"""
AS_OF_YEAR = 2026
RELEASES_SQL = f"""year_tags AS (
    SELECT album_id, count(DISTINCT CAST(tag_norm AS INTEGER)) AS n, min(CAST(tag_norm AS INTEGER)) AS y FROM album_tags
    WHERE regexp_full_match(tag_norm, '(19|20)[0-9]{{2}}') AND CAST(tag_norm AS INTEGER) BETWEEN 1900 AND {AS_OF_YEAR} GROUP BY album_id),
found AS (
    SELECT album_id, first_release_year AS a, resolution_method, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN y END AS b
    FROM albums LEFT JOIN looked_up USING (album_id) LEFT JOIN year_tags USING (album_id)),
releases AS (
    SELECT album_id, a AS musicbrainz_release_year, resolution_method AS musicbrainz_resolution_method, n AS lastfm_candidate_year_count, b AS lastfm_release_year, coalesce(a, b) AS release_year,
        CAST(floor(coalesce(a, b) / 10) * 10 AS INTEGER) AS release_decade, CASE WHEN a IS NOT NULL THEN 'musicbrainz' WHEN b IS NOT NULL THEN 'lastfm_year_tag' ELSE 'unknown' END AS release_year_source,
        a IS NOT NULL OR b IS NOT NULL AS has_release_year, a IS NOT NULL AND b IS NOT NULL AS both_sources_available,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a = b END AS exact_year_match, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a // 10 = b // 10 END AS same_decade,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a // 10 <> b // 10 END AS release_decade_conflict
    FROM found)"""
