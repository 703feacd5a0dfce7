"""Readers of exported files and caches, and sinks; schemas are explicit, so no pass infers them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRM_SCHEMA = "crm_record_id string, created_at timestamp_ntz, name string, email string, phone string, zip_code string, source string, campaign string, service string, salesperson_id string, response_minutes int, qualified boolean, estimate_id string, won boolean, funnel_stage string"
MARKETING_SCHEMA = "marketing_record_id string, captured_at timestamp_ntz, platform string, source_label string, campaign string, name string, email string, phone string, zip_code string, service string, form_name string, landing_page string"

_NAMED = T.StructType([T.StructField("mbid", T.StringType()), T.StructField("#text", T.StringType())])
_TRACK = T.StructType(
    [T.StructField("artist", _NAMED), T.StructField("album", _NAMED), T.StructField("mbid", T.StringType()), T.StructField("name", T.StringType()), T.StructField("url", T.StringType())]
    + [T.StructField("date", T.StructType([T.StructField("uts", T.StringType())])), T.StructField("@attr", T.StructType([T.StructField("nowplaying", T.StringType())]))]
)
_PAGE = T.StructType([T.StructField("recenttracks", T.StructType([T.StructField("track", T.StringType()), T.StructField("@attr", T.StructType([T.StructField("user", T.StringType())]))]))])
_TAG = T.StructType([T.StructField("name", T.StringType()), T.StructField("count", T.LongType()), T.StructField("url", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema: zip codes keep their zeros."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)


def one_or_many(text: str, element: T.DataType) -> F.Column:
    """A JSON value that is an array or a single object, as an array; NULL stays NULL."""
    c = F.col(text)
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, T.ArrayType(element))).when(c.isNotNull(), F.array(F.from_json(c, element)))


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, ingested_at) of runs whose manifest was written."""
    raw = spark.read.schema("completed_at_utc string").option("multiLine", True).option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", True).json(root)
    return raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/manifest\.json$", 1).alias("run_id"), F.to_timestamp("completed_at_utc").alias("ingested_at"))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """bronze_scrobbles from page files of committed runs; positions count from 1."""
    pages = spark.read.schema(_PAGE).option("multiLine", True).option("pathGlobFilter", "page_*.json").option("recursiveFileLookup", True).json(root)
    placed = pages.select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/page_\d+\.json$", 1).alias("run_id"), F.regexp_extract("_metadata.file_path", r"page_(\d+)\.json$", 1).cast("int").alias("source_page"),
        F.regexp_extract("_metadata.file_path", r"([^/]+/page_\d+\.json)$", 1).alias("source_file"), F.col("recenttracks.@attr.user").alias("user_name"), F.col("recenttracks.track").alias("tracks"),
    ).join(F.broadcast(committed_runs(spark, root)), "run_id")
    rows = placed.select("*", F.posexplode(one_or_many("tracks", _TRACK)).alias("p", "t")).withColumn("source_position", F.col("p") + 1)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    uts = F.col("t.date.uts").cast("long")
    return rows.select(
        F.format_string("%s:%05d:%04d", "run_id", "source_page", "source_position").alias("observation_id"), "run_id", "source_page", "source_position", "user_name",
        F.col("t.artist.#text").alias("artist"), F.col("t.name").alias("track"), blank("t.album.#text").alias("album"), blank("t.artist.mbid").alias("artist_mbid"), blank("t.mbid").alias("track_mbid"), blank("t.album.mbid").alias("album_mbid"),
        F.timestamp_seconds(uts).alias("scrobbled_at"), uts.alias("scrobbled_at_uts"), F.col("t.url").alias("track_url"), (F.coalesce(F.col("t.@attr.nowplaying"), F.lit("false")) == "true").alias("is_now_playing"), "ingested_at", "source_file",
    )


def read_tag_cache(spark: SparkSession, path: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(enrichment, tags) of cached tag answers for `owner` (album_id or artist_id): S06, S07, S08, X05.

    Tags come only from answers with status ok; a single object counts as a list of one; blank names are dropped but keep their rank.
    """
    schema = T.StructType([T.StructField(owner, T.StringType()), T.StructField("status", T.StringType()), T.StructField("fetched_at_utc", T.StringType()), T.StructField("response", T.StructType([T.StructField("toptags", T.StructType([T.StructField("tag", T.StringType())]))]))])
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("tags", one_or_many("response.toptags.tag", _TAG))
    enrichment = raw.select(owner, "status", F.to_timestamp("fetched_at_utc").alias("fetched_at"), F.coalesce(F.size("tags"), F.lit(0)).alias("tag_count"))
    tags = raw.filter("status = 'ok'").select(owner, F.posexplode("tags").alias("p", "t")).filter(F.trim("t.name") != "")
    norm = F.regexp_replace(F.lower(F.trim("t.name")), r"\s+", " ")
    return enrichment, tags.select(owner, (F.col("p") + 1).alias("tag_rank"), F.col("t.name").alias("tag_raw"), norm.alias("tag_norm"), F.col("t.count").alias("tag_weight"), F.col("t.url").alias("tag_url"))


def read_release_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(enrichment, dated): all answers, and those with status ok and a year."""
    schema = "album_id string, album_mbid string, status string, musicbrainz_entity_type string, resolution_method string, release_group_mbid string, first_release_date string, first_release_year int, match_score int"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw, raw.filter("status = 'ok' AND first_release_year IS NOT NULL")


def read_alias_csv(spark: SparkSession, path: str, value: str = "canonical_genre") -> DataFrame:
    """(tag_norm, value), the last row of a tag wins, blank ones are skipped, a missing file is an empty list."""
    schema = f"tag_norm string, {value} string"
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], schema)
    rows = read_csv(spark, path, schema).withColumn("_at", F.monotonically_increasing_id())
    norm = F.regexp_replace(F.lower(F.trim("tag_norm")), r"\s+", " ")
    return rows.filter((F.trim("tag_norm") != "") & (F.trim(value) != "")).groupBy(norm.alias("tag_norm")).agg(F.max_by(value, "_at").alias(value))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalized names of a genre list."""
    raw = spark.read.schema("genres array<struct<name:string>>").option("multiLine", True).json(path)
    return raw.select(F.explode("genres.name").alias("n")).select(F.regexp_replace(F.lower(F.trim("n")), r"\s+", " ").alias("genre")).filter("genre <> ''").distinct()


def read_cells(spark: SparkSession, path: str, row_digits: int, column_digits: int) -> DataFrame:
    """A wide CSV matrix as cells (i, j, x): codes lead its header cells and first column; totals and other texts are left out, zeros kept."""
    raw = spark.read.option("header", True).csv(path)
    code = lambda text, n: text[:n] if text[:n].isdigit() and (len(text) == n or not text[n].isdigit()) else None
    named = {c: code(c.strip(), column_digits) for c in raw.columns[1:]}
    kept = [c for c, j in named.items() if j]
    pairs = F.explode(F.array(*[F.struct(F.lit(named[c]).alias("j"), F.col(f"`{c}`").try_cast("double").alias("x")) for c in kept]))
    row = F.regexp_extract(F.trim(F.col(f"`{raw.columns[0]}`")), rf"^(\d{{{row_digits}}})(?!\d)", 1)
    return raw.select(row.alias("i"), pairs.alias("p")).filter("i <> ''").select("i", "p.j", "p.x")


def checked_cells(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """cells, after one pass that raises ValueError for a wrong shape, a missing value or a repeated cell."""
    got = cells.agg(F.count_distinct("i").alias("r"), F.count_distinct("j").alias("c"), F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls")).first()
    if (got["r"], got["c"], got["n"], got["nulls"]) != (rows, columns, rows * columns, 0):
        raise ValueError(f"expected {rows} x {columns} full cells, got {got.asDict()}")
    return cells


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet with ZSTD."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header, in order, outer blanks kept (K03, O02). Rows are sorted by ranges: the files, read in order of their names, are sorted as a whole."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_metrics(row: DataFrame, path: str) -> None:
    """A one-row table as one JSON file, through the file system that the path names, so not only on the driver's disk."""
    spark = row.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps(row.first().asDict(), default=str, indent=2).encode()))
    finally:
        out.close()
