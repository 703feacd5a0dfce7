"""Mixing sources to target shares of tokens, by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.skew import spread_few
from tidemill.session import cut

#: The vocabulary whose tokens are counted; its path and pattern are parameters.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block, tokens a shard is made for, and bundles that the shards of a source are apportioned in: the totals of these reach the driver, whatever the number of shards.
BLOCK, SHARD, BUNDLES = 512, 1_000_000, 4096


def count_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """df with `tokens`, the number of tokens of a text by a byte-level BPE vocabulary; 0 for NULL or empty texts.

    The vocabulary file (under 1 MB) is read on the driver and sent to the executors. Batches go through Arrow.
    """
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(x)) if x else 0 for x in texts], dtype="int64")

    counted = F.pandas_udf(count, T.LongType())  # type: ignore[call-overload]
    return df.withColumn("tokens", counted(F.col(text)))


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients weight / (2*given + 1); a party at its cap gets no more, seats that none can take stay empty.

    Equal quotients go to the earlier party. The divisor is found by bisection, so the work doesn't grow with the seats.
    """
    w = np.array(weights, float)
    cap = np.array([seats] * len(w) if caps is None else caps, np.int64)
    able = (w > 0) & (cap > 0)
    given = np.zeros(len(w), np.int64)
    if not able.any() or seats <= 0:
        return given.tolist()
    at = lambda d: np.where(able, np.minimum(cap, np.floor(w / d + 0.5)), 0).astype(np.int64)
    low, high = w[able].min() / (4.0 * seats + 4), w[able].sum() * 2 + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    # A little beyond the divisor, so that no quotient on the edge is rounded into it; the heap gives out the few seats left.
    given = at(high * (1 + 1e-9))
    heap = [(-w[i] / (2 * given[i] + 1), i) for i in np.flatnonzero(able) if given[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(int(seats - given.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * given[i] + 1), i))
    return given.tolist()


def plan_quotas(bundles: list[tuple[str, int, int, int]], targets: dict[str, tuple[float, int]], block: int) -> list[tuple[str, int, int]]:
    """(source, bundle, quota): how many blocks each bundle of shards contributes.

    bundles: (source, bundle, tokens, blocks). The mixture is as large as the source allows that runs out first when repeated as often as it may be.
    A source without tokens is left out; the others keep their proportions.
    """
    parts = {s: [(k, t, n) for source, k, t, n in sorted(bundles) if source == s and t > 0] for s in targets}
    live = [s for s in sorted(targets) if targets[s][0] > 0 and parts[s] and targets[s][1] > 0]
    if not live:
        return []
    held = {s: sum(t for _, t, _ in parts[s]) for s in live}
    size = min(targets[s][1] * held[s] / targets[s][0] for s in live) * sum(targets[s][0] for s in live)
    caps = [targets[s][1] * sum(n for _, _, n in parts[s]) for s in live]
    quotas = sainte_lague([targets[s][0] for s in live], max(1, int(size // block)), caps)
    plan = []
    for s, quota in zip(live, quotas):
        given = sainte_lague([t for _, t, _ in parts[s]], quota, [targets[s][1] * n for _, _, n in parts[s]])
        plan += [(s, k, q) for (k, _, _), q in zip(parts[s], given)]
    return plan


def plan_shards(shards: pd.DataFrame) -> pd.DataFrame:
    """One bundle's quota apportioned to its shards: (source, shard, blocks, full, rest), each block of the shard being taken `full` times, and `rest` of them once more.

    shards: source, shard, tokens, blocks, and the quota and max_repeats of the bundle in every row.
    """
    part = shards.sort_values("shard")
    given = np.array(sainte_lague(part["tokens"].tolist(), int(part["quota"].iloc[0]), (part["blocks"] * part["max_repeats"]).tolist()), np.int64)
    return pd.DataFrame({"source": part["source"].to_numpy(), "shard": part["shard"].to_numpy(), "blocks": part["blocks"].to_numpy(), "full": given // part["blocks"].to_numpy(), "rest": given % part["blocks"].to_numpy()})


def mixture(documents: DataFrame, doc_id: str, text: str, source: str, mix_targets: DataFrame, seed: int = 1, block: int = BLOCK, shard: int = SHARD, vocabulary: str = VOCABULARY, bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document in the mixture; copies is at most max_repeats.

    Documents are dealt by a seeded hash to shards, whose number follows the tokens of the source, so a source with a third of all rows is many
    tasks. A shard's documents, in seeded order, form blocks of `block` tokens; a document belongs to the block that holds its middle. Blocks are
    apportioned to sources, then to bundles of shards, on the driver, then in the tasks to the shards of each bundle; of each shard the blocks after a seeded start are taken.
    Only the totals of bundles reach the driver, `bundles` a source at most, however many shards there are.
    Documents of NULL or unlisted sources, and those without tokens, are left out.
    """
    listed = mix_targets.select(F.col("source").alias("_source"), "target_share", "max_repeats").collect()
    targets = {r["_source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in listed if r["_source"] is not None}
    chosen = documents.filter(F.col(source).isin(sorted(targets)) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = cut(count_tokens(spread_few(chosen, "doc_id"), "text", vocabulary).select("doc_id", "source", "tokens").filter("tokens > 0"))
    totals = {r["source"]: r["tokens"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shards = {s: max(1, -(-totals.get(s, 0) // shard)) for s in targets}
    of_source = lambda values: F.create_map(*[F.lit(x) for s in targets for x in (s, values(s))])[F.col("source")] if targets else F.lit(1).cast("long")
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), of_source(lambda s: shards[s])))
    held = cut(dealt.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("tokens") / F.lit(block)))))
    held = held.withColumn("bundle", F.floor(F.col("shard") / of_source(lambda s: -(-shards[s] // bundles))))
    sums = [tuple(r) for r in held.groupBy("source", "bundle").agg(F.sum("tokens"), F.sum("blocks")).collect()]
    quotas = documents.sparkSession.createDataFrame([(s, k, q, targets[s][1]) for s, k, q in plan_quotas(sums, targets, block)], "source string, bundle long, quota long, max_repeats int")
    plan = held.join(F.broadcast(quotas), ["source", "bundle"]).groupBy("source", "bundle").applyInPandas(plan_shards, "source string, shard long, blocks long, full long, rest long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("middle", F.sum("tokens").over(order) - F.col("tokens") / 2).join(plan, ["source", "shard"])
    number = F.least(F.floor(F.col("middle") / F.lit(block)), F.col("blocks") - 1)
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("blocks"))
    copies = F.col("full") + (F.pmod(number - first, F.col("blocks")) < F.col("rest")).cast("long")
    return placed.select("doc_id", "source", "tokens", copies.alias("copies")).filter("copies > 0").withColumnsRenamed({"doc_id": doc_id, "source": source})


def shares(mixed: DataFrame, mix_targets: DataFrame, source: str = "source") -> DataFrame:
    """One row per target: source, target_share, actual_share of the mixture's tokens, tokens, documents, max_repeats, most_copies. Sources without a document have 0."""
    taken = mixed.groupBy(source).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    by_source = mix_targets.join(taken, source, "left").select(source, "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "most_copies")])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return by_source.select(source, "target_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), total.cast("double")), F.lit(0.0)).alias("actual_share"), "tokens", "documents", "max_repeats", "most_copies")
