"""Groups of all that is linked directly or indirectly, by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.components import number_in_order
from tidemill.operators.skew import HOT_ROWS, join_by_size
from tidemill.session import cut, release


def _print_of(pairs: DataFrame) -> tuple:
    """Count and two independent 64-bit digests of a set of pairs; equal sets have equal prints."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64(F.lit(1), "v", "u")), F.bit_xor(F.xxhash64(F.lit(2), "v", "u"))).first())


def hash_to_min(edges: DataFrame, src: str = "src", dst: str = "dst", hot_rows: int = HOT_ROWS, max_rounds: int = 60) -> DataFrame:
    """One row (node, group_key) per node of edges; group_key is the smallest node of its component.

    Every vertex v holds a set, kept as rows (v, u) and never as an array. In each round it sends the set to the
    smallest member m and m to every member: rows (m, u) and (u, m), then made distinct. The rounds end when no set
    changes; their number follows the logarithm of the longest chain. A vertex with a large set, such as the
    smallest of a giant component, is split: its minimum is broadcast (see join_by_size).
    Each round is cut by a reliable checkpoint. Edges with a NULL end are dropped, loops keep a lone node,
    repeated edges count once, and an empty table gives no rows.
    """
    e = edges.select(F.col(src).alias("v"), F.col(dst).alias("u")).filter(F.col("v").isNotNull() & F.col("u").isNotNull())
    loops = e.select("v", F.col("v").alias("u")).union(e.select(F.col("u").alias("v"), "u"))
    pairs = cut(e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).union(loops).distinct())
    before = _print_of(pairs)
    for _ in range(max_rounds):
        smallest = pairs.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        sent = join_by_size(pairs, smallest, "v", "n", hot_rows).select("u", "m")
        pairs = cut(sent.select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("p")).select("p.v", "p.u").distinct())
        after = _print_of(pairs)
        if after == before:
            break
        before = after
        del smallest, sent
        release(pairs.sparkSession)
    else:
        raise RuntimeError(f"the groups weren't stable after {max_rounds} rounds")
    return pairs.groupBy("v").agg(F.min("u").alias("group_key")).withColumnRenamed("v", "node")


def groups_of_texts(edges: DataFrame, src: str = "src", dst: str = "dst", hot_rows: int = HOT_ROWS) -> DataFrame:
    """hash_to_min for nodes that are texts: numbered once in their order, so that all rounds move two longs a row, and named again at the end.

    The number of the smallest member is the smallest number, so the groups are the same. Joins to the names are by the unique number or text of a node;
    a node with very many edges is joined by broadcast (see join_by_size).
    """
    e = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter(F.col("s").isNotNull() & F.col("d").isNotNull()).distinct())
    degrees = e.select(F.explode(F.array("s", "d")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = cut(number_in_order(degrees, "node", "no"))
    named = lambda end, no: nodes.select(F.col("node").alias(end), F.col("no").alias(no), "degree")
    half = join_by_size(e, named("s", "src"), "s", "degree", hot_rows).select("src", "d")
    numbered = join_by_size(half, named("d", "dst"), "d", "degree", hot_rows).select("src", "dst")
    found = cut(hash_to_min(numbered, hot_rows=hot_rows))
    sizes = found.groupBy("group_key").agg(F.count("*").alias("members"))
    heads = sizes.join(nodes.select(F.col("no").alias("group_key"), F.col("node").alias("head")), "group_key")
    return join_by_size(found, heads, "group_key", "members", hot_rows).join(nodes.select("no", F.col("node").alias("text")), F.col("node") == F.col("no")).select(F.col("text").alias("node"), F.col("head").alias("group_key"))


def _plain(c: str):
    return F.upper(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))


def archive_links(match_pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges (src, dst) between nodes `system:RECORD`, and loops for records without a link.

    A shared reconciled_lead_id is a node of its own, `~` and the id, which sorts behind all records: a group of n records has n
    edges, not n*n. Outer blanks and letter case never matter; rows without a system or record id are dropped.
    """
    node = lambda system, c: F.concat(F.lower(system), F.lit(":"), F.nullif(_plain(c), F.lit("")))
    accepted = F.lower(_plain("review_status")).isin("auto_match", "confirmed")
    both = match_pairs.select(node(F.lit("crm"), "crm_record_id").alias("src"), node(F.lit("marketing"), "marketing_record_id").alias("dst"), accepted.alias("ok"))
    both = both.withColumn("ok", F.col("ok") & F.col("src").isNotNull() & F.col("dst").isNotNull())
    linked = both.filter("ok").select("src", "dst")
    lone = both.filter("NOT coalesce(ok, false)").select(F.explode(F.array("src", "dst")).alias("src")).select("src", F.col("src").alias("dst"))
    member = node(F.nullif(_plain("system"), F.lit("")), "record_id")
    lead = F.nullif(_plain("reconciled_lead_id"), F.lit(""))
    shared = membership.select(member.alias("src"), F.coalesce(F.concat(F.lit("~"), lead), member).alias("dst"))
    return linked.union(lone).union(shared)


def record_groups(match_pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """One row (system, record_id, group_key) per record of the archive, linked or not."""
    found = groups_of_texts(archive_links(match_pairs, membership)).filter(~F.col("node").startswith("~"))
    return found.select(F.split_part("node", F.lit(":"), F.lit(1)).alias("system"), F.expr("substring(node, instr(node, ':') + 1)").alias("record_id"), "group_key")
