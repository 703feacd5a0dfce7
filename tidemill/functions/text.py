"""Text keys as column expressions, all in the JVM; similarities by Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _fold_table(more: dict[str, str]) -> tuple[str, str]:
    """(from, to) for translate: every character whose compatibility decomposition without marks is one ASCII character, then marks on their own, which are dropped."""
    pairs = dict(more)
    for ch in map(chr, [*range(0xA0, 0x3000), *range(0xFF00, 0xFFF0)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain != ch:
            pairs.setdefault(ch, plain.lower())
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + marks, "".join(pairs.values())


DECOMPOSED = _fold_table({})
#: Besides, letters that have no decomposition but a plain look-alike.
FOLDED = _fold_table({"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ı": "i", "ŧ": "t"})


def blank_to_null(c: Column) -> Column:
    """Trimmed text; NULL where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def lower_key(c: Column) -> Column:
    """Trimmed and in lower case; NULL for NULL or blank."""
    return F.lower(blank_to_null(c))


def fold_marks(c: Column) -> Column:
    """Lower case without the marks of Latin letters; ligatures are spelled out."""
    low = F.translate(F.lower(c), *FOLDED)
    return F.replace(F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def decomposed(c: Column) -> Column:
    """Lower case without marks, by compatibility decomposition alone: letters such as ø, ł or ß, which have none, stay. Ligatures of several letters stay too."""
    return F.translate(F.lower(c), *DECOMPOSED)


def compact_key(c: Column) -> Column:
    """Only letters and digits, in lower case; NULL where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), F.lit(""))


def accent_key(c: Column) -> Column:
    """compact_key after decomposed."""
    return compact_key(decomposed(c))


def name_key(c: Column) -> Column:
    """ASCII letters and digits of a name, decomposed, in lower case; letters without a decomposition are dropped; NULL where nothing is left."""
    return F.nullif(F.regexp_replace(decomposed(c), "[^a-z0-9]", ""), F.lit(""))


def tag_key(c: Column) -> Column:
    """Lower case, outer blanks gone, runs of white space as one space; NULL where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), F.lit(""))


def phone_key(c: Column) -> Column:
    """Ten digits, of which a leading 1 of eleven is dropped; NULL for any other count of digits."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))


def phone_key_loose(c: Column) -> Column:
    """As phone_key, but digits of any other count are kept as they are; NULL where there is none."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(F.nullif(digits, F.lit("")))


def zip_key(c: Column) -> Column:
    """The first five digits; NULL where there are fewer."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 5, F.substring(digits, 1, 5))


def zip_key_loose(c: Column) -> Column:
    """The first five digits, or as many as there are; NULL where there is none."""
    return F.nullif(F.substring(F.regexp_replace(c, r"\D", ""), 1, 5), F.lit(""))


def email_key(c: Column) -> Column:
    """Trimmed and in lower case; NULL for NULL or blank."""
    return lower_key(c)


def md5_key(*parts: Column) -> Column:
    """MD5 of the parts joined by `|`; NULL parts are skipped, as CONCAT_WS does."""
    return F.md5(F.concat_ws("|", *parts))


def leading_code(c: Column, digits: int) -> Column:
    """The code that a cell starts with, padded to `digits` with zeros; NULL for text without one."""
    found = F.regexp_extract(F.trim(c), r"^(\d+)(?:\.0+)?(?:\s|$)", 1)
    return F.when((found != "") & (F.length(found) <= digits), F.lpad(found, digits, "0"))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, as one row of the dynamic program folded over a."""
    right = F.split(b, "")
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def step(row: Column, ch: Column) -> Column:
        cells = F.transform(
            F.arrays_zip(right.alias("c"), F.slice(row, 1, F.length(b)).alias("d"), F.slice(row, 2, F.length(b)).alias("u")),
            lambda z: F.when(z["c"] == ch, z["d"] + 1).otherwise(z["u"]),
        )
        running = F.aggregate(
            cells,
            F.struct(F.array(F.lit(0)).alias("r"), F.lit(0).alias("m")),
            lambda s, v: F.struct(F.concat(s["r"], F.array(F.greatest(s["m"], v))).alias("r"), F.greatest(s["m"], v).alias("m")),
        )
        return running["r"]

    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(F.element_at(F.aggregate(F.split(a, ""), start, step), -1))


def common_lengths(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Lengths of the longest common subsequences of texts, pair by pair; -1 where one is missing.

    Bit-parallel, one row of the dynamic program to a word of 64 bits, for all pairs of a batch at once; texts that are both longer than 64 letters take Python's long integers.
    """
    out = np.full(len(a), -1, np.int64)
    pairs: dict[tuple[str, str], int] = {}
    where = [pairs.setdefault((x, y) if len(x) <= len(y) else (y, x), len(pairs)) if isinstance(x, str) and isinstance(y, str) else -1 for x, y in zip(a, b)]
    texts = list(pairs)
    found = np.zeros(len(texts), np.int64)
    small = [k for k, (x, _) in enumerate(texts) if 0 < len(x) <= 64]
    # Pairs with a longer text of about the same length go together.
    small.sort(key=lambda k: len(texts[k][1]))
    for at in range(0, len(small), 1024):
        part = small[at : at + 1024]
        short, long = [texts[k][0] for k in part], [texts[k][1] for k in part]
        codes = lambda side: np.array(side).view(np.uint32).reshape(len(side), -1)
        x, y = codes(short), codes(long)
        lengths, longest = np.array([len(t) for t in short]), np.array([len(t) for t in long])
        full = np.uint64(2**64 - 1) >> (64 - lengths).astype(np.uint64)
        # Letters are numbered, and where each stands in its short text is one word.
        letters = np.unique(y)
        masks = np.zeros((len(part), len(letters) + 1), np.uint64)
        place = lambda c: np.where(np.isin(c, letters), np.searchsorted(letters, c), len(letters))
        rows, px, py = np.arange(len(part)), place(x), place(y)
        for i in range(x.shape[1]):
            on = rows[lengths > i]
            masks[on, px[on, i]] |= np.uint64(1) << np.uint64(i)
        masks[:, len(letters)] = 0
        row = full.copy()
        for j in range(y.shape[1]):
            hit = np.where(longest > j, row & masks[rows, py[:, j]], np.uint64(0))
            row = ((row + hit) | (row - hit)) & full
        found[part] = np.bitwise_count(full ^ row)
    for k, (x, y) in enumerate(texts):
        if len(x) > 64:
            masks: dict[str, int] = {}
            for i, ch in enumerate(x):
                masks[ch] = masks.get(ch, 0) | 1 << i
            row = full = (1 << len(x)) - 1
            for ch in y:
                hit = row & masks.get(ch, 0)
                row = (row + hit | row - hit) & full
            found[k] = (full ^ row).bit_count()
    at = np.array(where, np.int64)
    out[at >= 0] = found[at[at >= 0]]
    return out


@F.pandas_udf(T.LongType())
def lcs_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    """common_lengths of two columns, by Arrow batches."""
    return pd.Series(common_lengths(a, b))


def similarity_ratio(a: Column, b: Column) -> Column:
    """Normalized insert-delete similarity 2*LCS/(len a + len b); 1 for equal texts, NULL where one is NULL."""
    total = F.length(a) + F.length(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(1.0)).otherwise(F.lit(2.0) * lcs_lengths(a, b) / total)
