"""Apportionment and mixtures."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import mixing as M


def one_by_one(weights, seats, caps):
    given_ = [0] * len(weights)
    for _ in range(seats):
        able = [i for i, w in enumerate(weights) if w > 0 and given_[i] < caps[i]]
        if not able:
            break
        best = max(able, key=lambda i: (weights[i] / (2 * given_[i] + 1), -i))
        given_[best] += 1
    return given_


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 60))
def test_equals_seat_by_seat(parties, seats):
    weights, caps = [w for w, _ in parties], [c for _, c in parties]
    assert M.sainte_lague(weights, seats, caps) == one_by_one(weights, seats, caps)


def docs(spark):
    data = [(k, f"word{k % 7} " * (5 + k % 40), "abc"[k % 3] if k % 10 else None) for k in range(1500)] + [(9001, None, "a"), (9002, "", "a"), (None, "x", "a"), (9003, "tokens of an unlisted source", "z")]
    return spark.createDataFrame(data, "doc_id long, text string, source string")


def test_shares_and_repeats(spark):
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.1, 4), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(docs(spark), "doc_id", "text", "source", targets, shard=5000, block=64).cache()
    got = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.02 for r in got.values())
    assert all(r["most_copies"] <= r["max_repeats"] for r in got.values())
    assert got["a"]["most_copies"] == 2
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    again = M.mixture(docs(spark), "doc_id", "text", "source", targets, shard=5000, block=64)
    assert mixed.exceptAll(again).count() == 0
    other = M.mixture(docs(spark), "doc_id", "text", "source", targets, shard=5000, block=64, seed=2)
    assert mixed.exceptAll(other).count() > 0


def test_bundles_of_shards(spark):
    """Shards without a bound, apportioned in few bundles: shares and repeats hold as with one bundle a shard."""
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    for bundles in (1, 3, 4096):
        mixed = M.mixture(docs(spark), "doc_id", "text", "source", targets, shard=1500, block=16, bundles=bundles).cache()
        got = {r["source"]: r for r in M.shares(mixed, targets).collect()}
        assert all(abs(r["actual_share"] - r["target_share"]) < 0.03 and r["most_copies"] <= r["max_repeats"] for r in got.values())
    quotas = M.plan_quotas([("a", k, 1000, 10) for k in range(5000)] + [("b", 0, 10, 1)], {"a": (0.5, 1), "b": (0.5, 9)}, 100)
    assert sum(q for s, _, q in quotas if s == "a") <= 2 and len(quotas) == 5001


def test_tokens_are_those_of_the_vocabulary(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("t", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "Hello  world's", "ação\n\n12345", "<|endoftext|>", None]
    got = M.count_tokens(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t").orderBy("k").collect()
    assert [r["tokens"] for r in got] == [len(plain.encode_ordinary(t)) if t else 0 for t in texts]


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    empty = M.mixture(docs(spark).limit(0), "doc_id", "text", "source", targets)
    assert empty.count() == 0
    assert [tuple(r) for r in M.shares(empty, targets).select("source", "actual_share", "tokens").collect()] == [("a", 0.0, 0)]
    assert M.mixture(docs(spark), "doc_id", "text", "source", targets.limit(0)).count() == 0
