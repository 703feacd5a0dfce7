"""Leaks of evaluation items, planted and counted by a plain search."""

import random

import numpy as np

from tests.conftest import rows
from tidemill.llm import leaks as L

WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "ri", "su", "te") for b in ("lan", "dor", "vik", "pes") for c in ("", "a", "um", "is")]


def text(r, n):
    return " ".join(r.choice(WORDS) + (r.choice(["", "", ",", "."])) for _ in range(n))


def damage(r, words, rate):
    out = []
    for w in words:
        x = r.random()
        if x < rate / 3:
            continue
        out.append(w + "x" if x < 2 * rate / 3 else w)
        if x > 1 - rate / 3:
            out.append("extra")
    return out


def planted(seed=5, n_docs=300):
    r = random.Random(seed)
    items = [(k, text(r, r.randint(35, 80))) for k in range(40)]
    docs, truth = [], set()
    for d in range(n_docs):
        body = text(r, r.randint(40, 300)).split()
        if d % 3 == 0:
            k, words = items[r.randrange(40)][0], None
            words = items[k][1].split()
            size = int(len(words) * r.uniform(0.62, 1.0))
            at = r.randint(0, len(words) - size)
            body[10:10] = damage(r, words[at : at + size], 0.06)
            truth.add((d, k))
        elif d % 3 == 1:
            words = items[r.randrange(40)][1].split()
            body[5:5] = words[: int(len(words) * 0.35)]
        docs.append((d, " ".join(body).upper() if d % 2 else "<p>" + "\n ".join(body) + "&nbsp;</p>"))
    return items, docs, truth


def test_recall_and_precision(spark):
    items, docs, truth = planted()
    got = set(map(tuple, L.find_leaks(spark.createDataFrame(docs, "id long, body string"), "id", "body", spark.createDataFrame(items, "item long, q string"), "item", "q").select("id", "item").collect()))
    assert len(got & truth) >= 0.95 * len(truth)
    assert not got - truth


def test_alignment_equals_plain_program():
    r = np.random.default_rng(3)
    for _ in range(40):
        item, doc = r.integers(1, 5, 12), r.integers(1, 5, 20)
        span = L.best_stretch(item, np.array([0]), np.array([12]), doc, np.array([0]), np.array([20]), np.array([0]), band=25)[0]
        best, table = (0, 0), {}
        for i in range(12):
            for j in range(20):
                options = [(table.get((i - 1, j - 1), (0, i))[0] + (1 if item[i] == doc[j] else -2), table.get((i - 1, j - 1), (0, i))), (table.get((i - 1, j), (0, i))[0] - 2, table.get((i - 1, j), (0, i))), (table.get((i, j - 1), (0, i))[0] - 2, table.get((i, j - 1), (0, i)))]
                score, source = max(options, key=lambda o: o[0])
                table[i, j] = (max(score, 0), source[1] if source[0] > 0 else i)
                if table[i, j][0] == 0:
                    table[i, j] = (0, i + 1)
                best = max(best, (table[i, j][0], 0))
        plain = best[0]
        # The stretch is at least as long as its score, and no alignment scores more words than the item has.
        assert plain <= span <= 12


def test_edges(spark):
    r = random.Random(1)
    q = text(r, 40)
    items = [(1, q), (2, None), (3, ""), (4, "!!!")]
    docs = [(1, None), (2, ""), (3, q), (3, q), (4, (text(r, 50) + " ") * 400 + q), (5, "é" * 20000), (None, q)]
    found = L.find_leaks(spark.createDataFrame(docs, "id long, body string"), "id", "body", spark.createDataFrame(items, "item long, q string"), "item", "q")
    assert rows(found, "id", "item") == [(3, 1), (3, 1), (4, 1)]
    assert L.find_leaks(spark.createDataFrame([], "id long, body string"), "id", "body", spark.createDataFrame(items, "item long, q string"), "item", "q").count() == 0
    assert L.find_leaks(spark.createDataFrame(docs, "id long, body string"), "id", "body", spark.createDataFrame([], "item long, q string"), "item", "q").count() == 0


def test_item_tables_find_the_same(spark):
    """A set too large to be sent meets the documents by a shuffle, with the same result."""
    items, docs, _ = planted(n_docs=120)
    docs += [(997, items[0][1]), (998, None), (999, ""), (997, items[0][1])]
    find = lambda sent: rows(L.find_leaks(spark.createDataFrame(docs, "id long, body string"), "id", "body", spark.createDataFrame(items, "item long, q string"), "item", "q", sent=sent).selectExpr("id", "item", "round(share, 9)"))
    assert find(3) == find(5000) != []
