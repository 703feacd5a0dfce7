"""Choice of an album's release date among looked-up candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.dates import year_of_partial_date
from tidemill.functions.text import decomposed

# Texts that mark an edition wherever they stand in a qualifier.
EDITION_MARKS = ["edition", "version", "release", "expanded", "deluxe", "bonus", "remaster", "remastered", "remix", "anniversary", "reissue", "live from", " anos"]
# Primary types from best to worst.
TYPE_RANK = {"Album": 4, "EP": 3, "Single": 2, "Broadcast": 1, "Other": 0}
# Dashes and quotes that count as their plain forms.
DASHES, QUOTES = "‐–—", "’‘"


def search_title(c: Column) -> Column:
    """A title as it is searched for: outer quotes gone, without marks, quotes and dashes plain, `&` spelled out, blanks single."""
    bare = F.regexp_replace(F.trim(c), r'^"(.*)"$|^“(.*)”$', "$1$2")
    spelled = F.replace(F.replace(decomposed(bare), F.lit("ß"), F.lit("ss")), F.lit("&"), F.lit(" and "))
    plain = F.translate(spelled, DASHES + QUOTES, "-" * len(DASHES) + "'" * len(QUOTES))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def marks_edition(qualifier: Column) -> Column:
    """Whether a qualifier holds a mark of an edition, letter case and runs of blanks aside."""
    plain = F.lower(F.trim(F.regexp_replace(qualifier, r"\s+", " ")))
    return F.exists(F.array(*map(F.lit, EDITION_MARKS)), lambda m: F.contains(plain, m))


def without_edition(c: Column) -> Column:
    """A title without its qualifier, if that marks an edition: the last pair of brackets at the end, else all after the first dash between blanks.

    Other titles, such as `Name (Live)`, only lose outer blanks.
    """
    title = F.trim(c)
    # What stands before and in the last brackets; what stands before and after the first dash. Both are empty where there is none.
    around, within = F.regexp_extract(title, r"^(.*?)\s*[(\[]([^()\[\]]+)[)\]]$", 1), F.regexp_extract(title, r"[(\[]([^()\[\]]+)[)\]]$", 1)
    before, after = F.regexp_extract(title, r"^(.*?)\s+[-–—]\s+(.+)$", 1), F.regexp_extract(title, r"^.*?\s+[-–—]\s+(.+)$", 1)
    return F.when(marks_edition(within), F.regexp_replace(around, r"[\s\-–—]+$", "")).when(marks_edition(after), F.trim(before)).otherwise(title)


def title_level(candidate: Column, artist: Column, album: Column) -> Column:
    """2 the same title, with or without the artist before it; 1 the title with a subtitle or a flip side; 0 another."""
    found, asked = search_title(candidate), search_title(album)
    prefix = F.concat(search_title(artist), F.lit(" - "))
    bare = F.when(found.startswith(prefix), F.replace(found, prefix, F.lit(""))).otherwise(found)
    longer = bare.startswith(F.concat(asked, F.lit(": "))) | bare.startswith(F.concat(asked, F.lit(" / ")))
    return F.when(bare == asked, 2).when(longer, 1).otherwise(0)


def credited(credits: Column, artist: Column) -> Column:
    """Whether the artist is among the credited names, marks of letters and case aside."""
    return F.coalesce(F.array_contains(F.transform(credits, search_title), search_title(artist)), F.lit(False))


def select_release(candidates: DataFrame) -> DataFrame:
    """One row per album with a candidate that can be trusted.

    candidates: album_id, artist, album, id, title, credits (names), first_release_date, primary_type, score. Titles without their edition are preferred;
    of the candidates at the best level one alone is taken; several are taken only if all known years agree, then the best type, score and fullest date. Albums
    whose best candidates disagree have no row. Repeated candidates count once; ties go to the smaller id.
    """
    base = without_edition(F.col("album"))
    has_base = search_title(base) != search_title(F.col("album"))
    tried = candidates.filter(F.col("id").isNotNull() & credited(F.col("credits"), F.col("artist"))).withColumn(
        "t", F.explode(F.when(has_base, F.array(F.struct(F.lit(0).alias("turn"), base.alias("asked")), F.struct(F.lit(1).alias("turn"), F.col("album").alias("asked")))).otherwise(F.array(F.struct(F.lit(1).alias("turn"), F.col("album").alias("asked")))))
    )
    levelled = tried.withColumn("level", title_level(F.col("title"), F.col("artist"), F.col("t.asked"))).filter("level > 0").withColumn("variant", (F.col("t.turn") == 0))
    year, rank = year_of_partial_date(F.col("first_release_date")), F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])[F.coalesce("primary_type", F.lit("Other"))]
    # Copies of a candidate that differ: the one with the best score, then the fullest and smallest date, title and type.
    better = F.struct(-F.coalesce("score", F.lit(0)), -F.length(F.coalesce("first_release_date", F.lit(""))), "first_release_date", "title", "primary_type")
    copy = F.struct("title", "primary_type", "first_release_date", "score", year.alias("year"), F.coalesce(rank, F.lit(0)).alias("type_rank"))
    rows = levelled.groupBy("album_id", "variant", "level", "id").agg(F.min_by(copy, better).alias("one")).select("album_id", "variant", "level", "id", "one.*")
    best = Window.partitionBy("album_id", "variant")
    strongest = rows.withColumn("top", F.max("level").over(best)).filter("level = top")
    order = F.struct(F.col("year").isNull(), -F.col("type_rank"), -F.coalesce("score", F.lit(0)), -F.length(F.coalesce("first_release_date", F.lit(""))), F.col("id"))
    chosen = strongest.groupBy("album_id", "variant").agg(F.count("*").alias("n"), F.count_distinct("year").alias("years"), F.min_by(F.struct("id", "title", "primary_type", "first_release_date", "year", "score"), order).alias("c")).filter("n = 1 OR years = 1")
    first = chosen.groupBy("album_id").agg(F.max_by(F.struct("n", "variant", "c"), "variant").alias("r"))
    method = F.concat(F.lit("release_group_search"), F.when(F.col("r.variant"), "_variant").otherwise(""), F.when(F.col("r.n") > 1, "_consensus").otherwise(""))
    return first.select(
        "album_id", method.alias("resolution_method"), F.col("r.c.id").alias("release_group_mbid"), F.col("r.c.title").alias("matched_title"), F.col("r.c.primary_type").alias("matched_primary_type"),
        F.col("r.c.first_release_date").alias("first_release_date"), F.col("r.c.year").alias("first_release_year"), F.col("r.c.score").alias("match_score"),
    )


def family_first_date(releases: DataFrame) -> DataFrame:
    """(album_id, first_date, n): the earliest dated release whose title fits the album or its group (G24). releases: album_id, artist, album, group_title, title, date."""
    fits = (title_level(F.col("title"), F.col("artist"), F.col("album")) > 0) | (title_level(F.col("title"), F.col("artist"), F.col("group_title")) > 0)
    dated = releases.filter(fits & year_of_partial_date(F.col("date")).isNotNull())
    return dated.groupBy("album_id").agg(F.min_by("date", F.struct(year_of_partial_date(F.col("date")), F.col("date"))).alias("first_date"), F.count("*").alias("n"))


def release_cascade(*tiers: DataFrame) -> DataFrame:
    """Rows of the first tier that knows an album (G22, G23); all tiers have the same columns, album_id among them."""
    found = tiers[0]
    for t in tiers[1:]:
        found = found.unionByName(t.join(found.select("album_id"), "album_id", "left_anti"))
    return found


def enrichment_candidates(dimension: DataFrame, cache: DataFrame, key: str, final: list[str], limit: int | None = None) -> DataFrame:
    """Rows that have no final answer in the cache yet, the most played first (S20, G26, T07, Q24). cache: key, status."""
    todo = dimension.join(cache.filter(F.col("status").isin(final)).select(key), key, "left_anti").orderBy(F.desc("scrobble_count"), key)
    return todo if limit is None else todo.limit(limit)
