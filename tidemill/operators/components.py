"""Connected components by alternating stars, and numbering in a global order without one sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.skew import HOT_ROWS, join_by_size
from tidemill.session import cut


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64(F.lit(1), "u", "v")), F.bit_xor(F.xxhash64(F.lit(2), "u", "v"))).first())


def _large_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    """Every neighbour larger than u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    return join_by_size(both, least, "u", "n", hot_rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = join_by_size(down, least, "u", "n", hot_rows)
    linked = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return linked.select("e.u", "e.v").filter("u > v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, nodes: DataFrame | None = None, hot_rows: int = HOT_ROWS, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of its component.

    nodes: one column `node` of nodes that may have no edge and are then alone. NULL ends are dropped; loops and repeated edges don't matter.
    Each round is cut by a reliable checkpoint; hubs with very many neighbours are joined by broadcast.
    """
    e = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _digest(e)
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e, hot_rows), hot_rows))
        after = _digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components weren't stable after {max_rounds} rounds")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
    loops = edges.filter(F.col(src) == F.col(dst)).select(F.col(src).alias("node"))
    alone = loops if nodes is None else loops.union(nodes.select("node").filter(F.col("node").isNotNull()))
    return labels.union(alone.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def number_in_order(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `name`: 1, 2, ... in ascending order of a unique key.

    Rows are sorted by ranges of the key; only the number of rows of each range reaches the driver.
    """
    placed = cut(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(total)]
        total += n
    before = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return placed.withColumn(name, (before + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_at")
