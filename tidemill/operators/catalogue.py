"""Warehouse builds: tables written once in order, and an ordered catalogue of exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.files import write_table


def build_tables(spark: SparkSession, folder: str, builders: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
    """Write each table of builders to folder/name as Parquet, in order, and read it back.

    A builder is given a function that returns a table built before it, so shared steps are computed once and no plan starts again from the raw rows. A build replaces what
    is there; asking for a table that comes later is a KeyError.
    """
    built: dict[str, DataFrame] = {}
    for name, builder in builders.items():
        write_table(builder(built.__getitem__), f"{folder}/{name}")
        built[name] = spark.read.parquet(f"{folder}/{name}")
    return built


def export_all(folder: str, catalogue: dict[str, tuple[DataFrame, list[Column | str]]]) -> list[str]:
    """Write every entry (table, order) of the catalogue to folder/name.parquet, sorted by its order; the names in order.

    Rows are sorted by ranges, so the parts of an export, read in order, are sorted as a whole without a single sorting task.
    """
    for name, (table, order) in catalogue.items():
        write_table(table.orderBy(*order), f"{folder}/{name}.parquet")
    return list(catalogue)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under path (F05, S19). Files are hashed where they are read; a file must fit in memory, as Spark reads it whole."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"))


def title_label(c: Column, kept: dict[str, str] | None = None) -> Column:
    """A name as a label: every word with a capital, but those of `kept` as given there."""
    plain = F.lower(F.trim(c))
    exceptions = [F.when(plain == k.lower(), F.lit(v)) for k, v in (kept or {}).items()]
    return F.coalesce(*exceptions, F.initcap(plain))


def assigned_colours(names: DataFrame, name: str, order: str, palette: list[str], special: dict[str, str] | None = None) -> DataFrame:
    """(name, colour): special names have their own, the others the palette in order of their first place.

    Raises ValueError where the palette is too short. The names of a chart are few: no more than the palette and the special ones can be told apart, so no more are read.
    """
    fixed = special or {}
    found = names.filter(F.col(name).isNotNull() & ~F.col(name).isin(list(fixed))).groupBy(name).agg(F.min(order).alias("_at")).orderBy("_at", name).limit(len(palette) + 1).collect()
    if len(found) > len(palette):
        raise ValueError(f"more than {len(palette)} names for the palette")
    rows = [*fixed.items(), *[(r[name], colour) for r, colour in zip(found, palette)]]
    return names.sparkSession.createDataFrame(rows, f"{name} string, colour string")
