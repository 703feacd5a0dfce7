"""Languages of documents and of their segments, by a byte convolutional network."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.skew import spread_few

LANGUAGES = ["en", "pt", "es", "fr", "de"]
#: Bytes of a window, bytes of a letter's vector, filter widths and filters of each width.
LENGTH, DEPTH, WIDTHS, FILTERS = 128, 12, (2, 3, 4, 5), 32
#: Labelled documents of each language that the network is trained on, at most; rounds of training.
SAMPLE, EPOCHS = 300, 4
#: Letters a sentence must have to count, and the confidence at which it does.
LETTERS, SURE = 20, 0.9


def label_language(c: Column) -> Column:
    """The language that a label names in any notation (letter case, region), else NULL."""
    first = F.regexp_extract(F.lower(F.trim(c)), "^([a-z]{2})(?:$|[-_])", 1)
    return F.when(first.isin(LANGUAGES), first)


# Short forms whose dot ends no sentence.
SHORT_FORM = re.compile(r"\b(?:pt|mr|mrs|ms|dr|sr|sra|vol|st|feat)\.\s*$", re.IGNORECASE)


class Phrases:
    """Phrases that are of no language, such as tags, as they are or without marks of letters; found word by word, so their number doesn't matter."""

    def __init__(self, phrases: list[str]) -> None:
        plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        self.known = {words for x in phrases for y in (x.lower(), plain(x.lower())) if (words := tuple(re.findall(r"\w+", y)))}
        self.lengths: dict[str, list[int]] = {}
        for words in self.known:
            self.lengths.setdefault(words[0], []).append(len(words))
        self.lengths = {w: sorted(set(n), reverse=True) for w, n in self.lengths.items()}

    def blank(self, text: str) -> str:
        """The text with the longest phrase at each place blanked out."""
        spans = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        out, at, k = [], 0, 0
        while k < len(spans):
            n = next((n for n in self.lengths.get(spans[k][0], ()) if tuple(w for w, _, _ in spans[k : k + n]) in self.known), 0)
            if n:
                out += [text[at : spans[k][1]], " "]
                at = spans[k + n - 1][2]
            k += n or 1
        return "".join([*out, text[at:]]) if out else text


def sentences(text: str | None, blanked: Phrases | None = None) -> list[tuple[int, int, str]]:
    """(start, end, cleaned text) of the sentences of a text; tags, entities, addresses, quoted titles and the phrases in `blanked` are blanked out."""
    if not text:
        return []
    found, at = [], 0
    for end in [m.end() for m in re.finditer(r"[.!?…]+[\"'”’»*)\]]*(?=\s)|\n+", text)] + [len(text)]:
        part = text[at:end]
        if end < len(text) and SHORT_FORM.search(part):
            continue
        clean = re.sub(r"<[^<>]{0,200}>|https?://\S+|www\.\S+", " ", html.unescape(part))
        if blanked:
            clean = blanked.blank(clean)
        untitled = re.sub(r"“[^“”]{1,60}”|\"[^\"]{1,60}\"|«[^«»]{1,60}»|\*[^*]{1,60}\*", " ", clean)
        clean = re.sub(r"\s+", " ", untitled if any(ch.isalpha() for ch in untitled) else clean).strip().lower()
        if any(ch.isalpha() for ch in clean):
            found.append((at, end, clean))
        at = end
    return found


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of LENGTH bytes, the text each belongs to); the last window of a long text ends with it, short texts are padded with 0."""
    rows, owners = [], []
    for k, text in enumerate(texts):
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        starts = [0] if len(data) <= LENGTH else [*range(0, len(data) - LENGTH, LENGTH), len(data) - LENGTH]
        for s in starts:
            row = np.zeros(LENGTH, np.uint8)
            piece = data[s : s + LENGTH]
            row[: len(piece)] = piece
            rows.append(row)
            owners.append(k)
    return (np.stack(rows) if rows else np.zeros((0, LENGTH), np.uint8)), np.array(owners, np.int64)


class ByteNet:
    """Byte vectors, filters of several widths, ReLU, maximum over the window, softmax; trained by Adam in numpy."""

    def __init__(self, classes: int = len(LANGUAGES), seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"bytes": (rng.standard_normal((256, DEPTH)) * 0.3).astype(np.float32), "out": draw(FILTERS * len(WIDTHS), classes), "bias": np.zeros(classes, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = draw(w * DEPTH, FILTERS), np.zeros(FILTERS, np.float32)
        self.p["bytes"][0] = 0

    def pooled(self, x: np.ndarray, keep: bool = False):
        """Maxima of all filters; with keep also what the gradients need."""
        vectors = self.p["bytes"][x]
        flat, kept, tops = vectors.reshape(len(x), -1), [], []
        for w in WIDTHS:
            n = LENGTH - w + 1
            patches = np.lib.stride_tricks.as_strided(flat, (len(x), n, w * DEPTH), (flat.strides[0], DEPTH * 4, 4))
            act = (np.ascontiguousarray(patches).reshape(-1, w * DEPTH) @ self.p[f"w{w}"]).reshape(len(x), n, FILTERS)
            where = act.argmax(1) if keep else None
            top = act.max(1) + self.p[f"b{w}"]
            tops.append(np.maximum(top, 0))
            kept.append((patches, where, top))
        return np.concatenate(tops, 1), kept

    def log_probabilities(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        """Log of the softmax of each window."""
        parts = []
        for k in range(0, len(x), batch):
            z = self.pooled(x[k : k + batch])[0] @ self.p["out"] + self.p["bias"]
            z -= z.max(1, keepdims=True)
            parts.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(parts) if parts else np.zeros((0, len(LANGUAGES)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 3e-3, seed: int = 5) -> None:
        """Adam over shuffled batches; units are dropped at random so that no single letter group decides."""
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                rows = order[k : k + batch]
                grad = self._gradients(x[rows], y[rows], rng)
                t += 1
                for name, g in grad.items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    self.p[name] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        top, kept = self.pooled(x, keep=True)
        drop = (rng.random(top.shape) < 0.7).astype(np.float32) / 0.7
        hidden = top * drop
        z = hidden @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        grad = {"out": hidden.T @ d, "bias": d.sum(0), "bytes": np.zeros_like(self.p["bytes"])}
        dh = (d @ self.p["out"].T) * drop
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            patches, where, raw = kept[k]
            g = dh[:, k * FILTERS : (k + 1) * FILTERS] * (raw > 0)
            best = patches[rows, where]
            grad[f"w{w}"] = np.einsum("nfd,nf->df", best, g)
            grad[f"b{w}"] = g.sum(0)
            back = g[:, :, None] * self.p[f"w{w}"].T[None]
            for j in range(w):
                letters = x[rows, where + j].ravel()
                for c in range(DEPTH):
                    grad["bytes"][:, c] += np.bincount(letters, back[:, :, j * DEPTH + c].ravel(), 256).astype(np.float32)
        return grad


def labelled_sample(documents: DataFrame, doc_id: str, text: str, lang: str, sample: int = SAMPLE) -> pd.DataFrame:
    """(text, language) of `sample` labelled documents of each language at most: a bounded sample by hash, for training only.

    The first pass counts labels and reads no texts; the second keeps the documents whose hash lies under a share fitted to the counts.
    """
    language = label_language(F.col(lang))
    counts = {r["l"]: r["n"] for r in documents.groupBy(language.alias("l")).agg(F.count("*").alias("n")).collect() if r["l"]}
    if not counts:
        return pd.DataFrame({"text": [], "language": []})
    place = F.pmod(F.xxhash64(F.lit(11), F.col(doc_id)), F.lit(1_000_000))
    under = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, sample / n) * 1_000_000))])
    taken = documents.filter(language.isNotNull() & (place < under[language])).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), language.alias("language")).limit(2 * sample * len(LANGUAGES))
    return taken.toPandas().sort_values("id").groupby("language").head(sample)[["text", "language"]]


def train(sample: pd.DataFrame, blanked: Phrases | None = None) -> ByteNet | None:
    """A network fitted to the sentences of the sample, in two passes: the second leaves out sentences that the first is sure are labelled wrongly."""
    pairs = [(s, LANGUAGES.index(r.language)) for r in sample.itertuples() for _, _, s in sentences(r.text, blanked) if sum(map(str.isalpha, s)) >= LETTERS]
    if not pairs:
        return None
    x, owners = windows([s for s, _ in pairs])
    y = np.array([c for _, c in pairs])[owners]
    net = ByteNet()
    net.fit(x, y, 2)
    prob = np.exp(net.log_probabilities(x))
    good = prob[np.arange(len(y)), y] > 0.2
    net = ByteNet()
    net.fit(x[good], y[good])
    return net


def _classified(net: ByteNet, blanked: Phrases | None = None):
    """(document, start, end, letters, log probabilities) of the sentences of a list of texts."""

    def run(texts: list) -> tuple[list, np.ndarray]:
        found = [(k, a, b, sum(map(str.isalpha, s)), s) for k, t in enumerate(texts) for a, b, s in sentences(t, blanked)]
        x, owners = windows([f[4] for f in found])
        logs = net.log_probabilities(x)
        total = np.zeros((len(found), len(LANGUAGES)), np.float64)
        np.add.at(total, owners, logs)
        total /= np.maximum(1, np.bincount(owners, minlength=len(found)))[:, None] if len(found) else 1
        p = np.exp(total - total.max(1, keepdims=True)) if len(found) else total
        return found, p / p.sum(1, keepdims=True) if len(found) else p

    return run


def document_segments(documents: DataFrame, doc_id: str, text: str, net: ByteNet | None, blanked: Phrases | None = None) -> DataFrame:
    """(doc_id, segment, start_char, end_char, language, confidence): runs of sentences of one language, in order.

    A sentence the network isn't sure of has the likeliest of the languages it is sure of elsewhere in the document; one of fewer than LETTERS letters
    joins the segment before it (at the start, the one behind it). Where no sentence of a document is sure, all form one segment of the likeliest language. Confidence is the mean over the segment's letters. Documents without
    letters have no segment; phrases that `blanked` fits count for none. Whole texts are read; sentences longer than a window are read in several.
    """
    kinds = f"doc_id {dict(documents.dtypes)[doc_id]}, segment int, start_char int, end_char int, language string, confidence double, letters int"
    rows = spread_few(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull()), "doc_id")
    if net is None:
        return rows.sparkSession.createDataFrame([], kinds).withColumnRenamed("doc_id", doc_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = _classified(net, blanked)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame(_segments(part["doc_id"].tolist(), *classify(part["text"].tolist())), columns=["doc_id", "segment", "start_char", "end_char", "language", "confidence", "letters"])

    return rows.mapInPandas(run, kinds).withColumnRenamed("doc_id", doc_id)


def _segments(ids: list, found: list, p: np.ndarray) -> list[tuple]:
    out, k = [], 0
    while k < len(found):
        end = k
        while end < len(found) and found[end][0] == found[k][0]:
            end += 1
        letters = np.array([f[3] for f in found[k:end]], float)
        best = p[k:end].argmax(1)
        sure = (p[k:end].max(1) >= SURE) & (letters >= LETTERS)
        if sure.any():
            spoken = np.unique(best[sure])
            likely = spoken[p[k:end][:, spoken].argmax(1)]
            names = np.where(sure, best, np.where(letters >= LETTERS, likely, -1))
            for i in range(1, len(names)):
                names[i] = names[i - 1] if names[i] < 0 else names[i]
            names[names < 0] = names[names >= 0][0]
        else:
            names = np.full(end - k, (p[k:end] * letters[:, None]).sum(0).argmax())
        cuts = [0, *(np.flatnonzero(np.diff(names)) + 1), len(names)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            share = p[k + a : k + b, names[a]]
            out.append((ids[found[k][0]], n, found[k + a][1], found[k + b - 1][2], LANGUAGES[names[a]], float((share * letters[a:b]).sum() / max(1.0, letters[a:b].sum())), int(letters[a:b].sum())))
        k = end
    return out


def wrong_labels(documents: DataFrame, segments: DataFrame, doc_id: str, lang: str) -> DataFrame:
    """(doc_id, language) for documents whose label doesn't name their language or that mix languages: a row for each language of theirs."""
    spoken = segments.groupBy(doc_id).agg(F.collect_set("language").alias("spoken"))  # as many as there are LANGUAGES, at most
    labelled = spoken.join(documents.select(doc_id, label_language(F.col(lang)).alias("label")), doc_id)
    wrong = labelled.filter((F.size("spoken") > 1) | F.col("label").isNull() | (F.col("label") != F.col("spoken")[0]))
    return wrong.select(doc_id, F.explode("spoken").alias("language")).distinct()
