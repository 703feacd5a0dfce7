"""Evaluation items that stand, whole or in part, in training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import fold_marks
from tidemill.operators.skew import spread_few
from tidemill.session import cut

#: Words of a window and the step between windows of a document. More than half of an item of 25 words or more holds a whole window.
WINDOW, STEP = 10, 2
#: Repetitions of the walk and sampled places of each; see README for the recall measured with them.
REPEATS, SAMPLED = 8, 9
#: Diagonals on each side of a hit that the exact check follows, and what an altered, missing or added word costs it.
BAND, COST = 10, 2
#: Items that are sent to where the documents lie; a larger set is a table of its own, and meets the documents by a shuffle of keys.
SENT = 5000
PAD = np.int64(0)


def text_words(c: Column) -> Column:
    """64-bit hashes of the words of a text, without marks of letters, letter case, punctuation, tags and character entities."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^<>]{1,200}>", " "), r"&(?:[a-zA-Z]{2,8}|#x?[0-9a-fA-F]{1,6});", " ")
    words = F.filter(F.split(fold_marks(plain), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


class Walks:
    """CGK embeddings by random walks over words, of which each repetition samples a few places as a key.

    A walk copies the word it stands on and moves on, or not, by a random bit of step and word. Two windows a few edits apart fall into
    step again after each edit, so their copies differ in few places: edit distance becomes Hamming distance.
    """

    def __init__(self, window: int = WINDOW, repeats: int = REPEATS, sampled: int = SAMPLED, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.window, self.steps = window, 3 * window
        odd = lambda *shape: rng.integers(0, 2**63, shape, dtype=np.int64) | 1
        self.turn, self.mix = odd(repeats, self.steps), odd(repeats, sampled)
        self.places = [np.sort(rng.choice(2 * window, sampled, replace=False)) for _ in range(repeats)]

    def keys(self, words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The keys of the windows that begin at starts, one array for each repetition."""
        ends = starts + self.window
        padded = np.append(words, PAD)
        for turn, mix, places in zip(self.turn, self.mix, self.places):
            at, key, k = starts.copy(), np.zeros(len(starts), np.int64), 0
            for step in range(places[-1] + 1):
                word = np.where(at < ends, padded[np.minimum(at, len(words))], PAD)
                if step == places[k]:
                    key = (key ^ word) * mix[k]
                    key ^= (key >> np.int64(29)) & np.int64(0x7FFFFFFFF)
                    k += 1
                at += (word * turn[step]) < 0
            yield key


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows one behind another, and where each row begins."""
    sizes = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows).astype(np.int64) if len(rows) and sizes.sum() else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)])


def _windows(begins: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of the windows of each row; rows shorter than a window have one that is padded."""
    sizes = np.diff(begins)
    counts = np.where(sizes == 0, 0, np.maximum(1, (sizes - window) // step + 1))
    rows = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return begins[rows] + within * step, rows


def best_stretch(item: np.ndarray, i0: np.ndarray, i1: np.ndarray, doc: np.ndarray, d0: np.ndarray, d1: np.ndarray, diagonal: np.ndarray, band: int = BAND, cost: int = COST) -> np.ndarray:
    """Words of the item in its best local alignment with the document, for many pairs at once.

    Pair k aligns item[i0:i1] with doc[d0:d1] along doc place - item place = diagonal, `band` to each side. A word that agrees is worth 1, an edit
    costs `cost`, and a stretch is as long as its span of the item. All are arrays of one value a pair.
    """
    n, width = len(i0), 2 * band + 1
    item, doc = np.append(item, PAD), np.append(doc, PAD)
    score, begin = np.zeros((n, width), np.int32), np.zeros((n, width), np.int32)
    top, span = np.zeros(n, np.int32), np.zeros(n, np.int32)
    longest = int((i1 - i0).max(initial=0))
    offsets = np.arange(-band, band + 1)
    for i in range(longest):
        at_item = i0 + i
        alive = at_item < i1
        word = np.where(alive, item[np.minimum(at_item, len(item) - 1)], PAD)
        places = d0[:, None] + diagonal[:, None] + i + offsets
        inside = (places >= d0[:, None]) & (places < d1[:, None]) & alive[:, None]
        same = inside & (doc[np.clip(places, 0, len(doc) - 1)] == word[:, None])
        fresh = score <= 0
        base, base_begin = np.where(fresh, 0, score), np.where(fresh, i, begin)
        new = base + np.where(same, 1, -cost)
        new_begin = base_begin
        # A word of the item is missing: from the row before, one diagonal to the right.
        gap = np.full_like(score, -1)
        gap[:, :-1] = score[:, 1:] - cost
        better = gap > new
        new, new_begin = np.where(better, gap, new), np.where(better, np.concatenate([begin[:, 1:], begin[:, :1]], 1), new_begin)
        # Words of the document are added: along the row, from left to right.
        for b in range(1, width):
            along = new[:, b - 1] - cost
            take = along > new[:, b]
            new[:, b] = np.where(take, along, new[:, b])
            new_begin[:, b] = np.where(take, new_begin[:, b - 1], new_begin[:, b])
        score, begin = np.where(inside, np.maximum(new, 0), 0), new_begin
        peak = score.argmax(1)
        value, start = score[np.arange(n), peak], begin[np.arange(n), peak]
        wins = value > top
        top, span = np.where(wins, value, top), np.where(wins, i + 1 - start, span)
    return span


def find_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, more_than: float = 0.5, sent: int = SENT) -> DataFrame:
    """(doc_id, item_id, share) of documents that hold more than `more_than` of an item's words in one stretch.

    Windows of items at every place and those of the documents at every STEP-th are embedded and sampled; a document that shares a key with an item is aligned with it along
    the diagonal of the hit. Up to `sent` items are sent to where the documents lie, and nothing is shuffled; more items are a table, whose keys meet those of the documents by a
    shuffle, each pair of document, item and diagonal being aligned once. No document is compared with all items, and both ways find the same.
    NULL or empty texts and items hold nothing; repeated documents are each reported; whole texts are read, whatever their length.
    """
    words = spread_few(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull()), "doc_id").select("doc_id", text_words(F.col("text")).alias("w"))
    asked = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), text_words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    kinds = f"doc_id {dict(documents.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}, share double"
    few = asked.limit(sent + 1).collect()
    if len(few) <= sent:
        found = words.mapInPandas(_search([r["item_id"] for r in few], [np.array(r["w"], np.int64) for r in few], more_than), kinds)
    else:
        found = _join_by_keys(cut(words), cut(asked), more_than, kinds)
    return found.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})


def _keys_of(step: int):
    """(row, at, key) of the windows of every text of a batch, `row` being its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks = Walks()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                words, begins = _flat(list(part["w"]))
                starts, rows = _windows(begins, WINDOW, step)
                for k, key in enumerate(walks.keys(words, starts)):
                    # The number of the walk is part of the key: each samples places of its own.
                    yield pd.DataFrame({"no": part["no"].to_numpy()[rows], "at": starts - begins[rows], "key": key * np.int64(31) + np.int64(k)})

    return run


def _join_by_keys(words: DataFrame, asked: DataFrame, more_than: float, kinds: str) -> DataFrame:
    """find_leaks for item sets of any size: only keys, numbers and places are shuffled, and words only of pairs that share a key."""
    docs = cut(words.withColumn("no", F.monotonically_increasing_id()))
    known = cut(asked.withColumn("no", F.monotonically_increasing_id()))
    found = docs.select("no", "w").mapInPandas(_keys_of(STEP), "no long, at int, key long").withColumnsRenamed({"no": "doc", "at": "doc_at"})
    wanted = cut(known.select("no", "w").mapInPandas(_keys_of(1), "no long, at int, key long").withColumnsRenamed({"no": "item", "at": "item_at"}).distinct())
    # A document may hold a key at many places and an item too: what counts is the diagonal, reduced before and after they meet.
    met = found.join(wanted, "key").select("doc", "item", F.floor((F.col("doc_at") - F.col("item_at")) / F.lit(BAND)).alias("band")).distinct()
    paired = met.join(docs.select(F.col("no").alias("doc"), "doc_id", F.col("w").alias("doc_words")), "doc").join(known.select(F.col("no").alias("item"), "item_id", F.col("w").alias("item_words")), "item")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                doc, d = _flat(list(part["doc_words"]))
                item, i = _flat(list(part["item_words"]))
                share = best_stretch(item, i[:-1], i[1:], doc, d[:-1], d[1:], part["band"].to_numpy() * BAND + BAND // 2) / np.diff(i)
                yield part[["doc", "doc_id", "item_id"]].assign(share=share)[share > more_than]

    kept = paired.select("doc", "doc_id", "item_id", "band", "doc_words", "item_words").mapInPandas(align, f"doc long, {kinds}")
    return kept.groupBy("doc", "doc_id", "item_id").agg(F.max("share").alias("share")).drop("doc")


def _search(ids: list, item_words: list, more_than: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks = Walks()
        item, item_begins = _flat(item_words)
        starts, owners = _windows(item_begins, WINDOW, 1)
        tables = []
        for key in walks.keys(item, starts):
            order = np.argsort(key, kind="stable")
            tables.append((key[order], order))
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                yield _hits(part, walks, tables, item, item_begins, starts, owners)

    def _hits(part, walks, tables, item, item_begins, starts, owners) -> pd.DataFrame:
        doc, begins = _flat(list(part["w"]))
        places, rows = _windows(begins, WINDOW, STEP)
        hits = set()
        for (known, order), key in zip(tables, walks.keys(doc, places)):
            low = np.searchsorted(known, key, "left")
            count = np.searchsorted(known, key, "right") - low
            at = np.flatnonzero(count)
            if len(at):
                which = np.repeat(at, count[at])
                nth = np.arange(len(which)) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
                window = order[low[which] + nth]
                diagonal = (places[which] - begins[rows[which]]) - (starts[window] - item_begins[owners[window]])
                # Hits on diagonals closer than the band are one.
                hits.update(zip(rows[which].tolist(), owners[window].tolist(), (diagonal // BAND).tolist()))
        if not hits:
            return pd.DataFrame({"doc_id": [], "item_id": [], "share": []})
        pairs = np.array(sorted(hits), np.int64)
        spans = []
        for k in range(0, len(pairs), 4000):
            r, i, d = pairs[k : k + 4000].T
            spans.append(best_stretch(item, item_begins[i], item_begins[i + 1], doc, begins[r], begins[r + 1], d * BAND + BAND // 2))
        share = np.concatenate(spans) / np.diff(item_begins)[pairs[:, 1]]
        held = pd.DataFrame({"row": pairs[:, 0], "item": pairs[:, 1], "share": share})
        held = held[held["share"] > more_than].groupby(["row", "item"], as_index=False)["share"].max()
        return pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[held["row"]], "item_id": [ids[i] for i in held["item"]], "share": held["share"].to_numpy()})

    return run
