"""Names, e-mail addresses, phones and zip codes typed by people: keys, comparison, and links of variant spellings."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.text import fold_marks, phone_key_loose
from tidemill.llm.components import hash_to_min
from tidemill.operators.skew import join_by_size, spread, without_keys
from tidemill.session import cut, release

# Words that are no part of a name.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "dra", "sr", "sra", "srta", "prof", "herr", "frau", "the", "and"]
LEGAL_FORMS = ["llc", "inc", "incorporated", "ltd", "ltda", "limitada", "limited", "co", "comp", "company", "corp", "corporation", "associates", "assoc", "assocs", "gmbh"]
# Entries that stand in for a missing one.
NO_NAMES = ["homeowner", "unknown", "none", "na", "test", "customer", "n a", "no name", "anonymous"]
NO_MAILBOXES = ["none", "noemail", "na", "n/a", "no", "unknown", "test", "noreply"]
# Short forms of given names.
SHORT_FORMS = {
    "alex": "alexander", "sasha": "alexander", "drew": "andrew", "andy": "andrew", "angie": "angela", "toninho": "antonio", "tonho": "antonio", "tony": "antonio", "bia": "beatriz",
    "chris": "christopher", "kit": "christopher katherine", "ceica": "conceicao", "dani": "daniela", "deb": "deborah", "debbie": "deborah", "debra": "deborah", "edu": "eduardo", "dudu": "eduardo",
    "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "fe": "fernanda", "nanda": "fernanda", "chico": "francisco", "paco": "francisco", "gabe": "gabriel",
    "biel": "gabriel", "greg": "gregory", "gui": "guilherme", "guga": "guilherme gustavo", "lena": "helene helena", "isa": "isabella", "bella": "isabella", "jen": "jennifer", "jenny": "jennifer", "quim": "joaquim",
    "pepe": "jose", "ze": "jose", "kate": "katherine", "kathy": "katherine", "catherine": "katherine", "katie": "katherine", "leo": "leonardo", "luis": "luiz", "lula": "luiz", "maggie": "margaret", "meg": "margaret",
    "peggy": "margaret", "mari": "mariana", "nana": "mariana naomi", "matt": "matheus matthew", "teteu": "matheus", "mike": "michael", "mick": "michael", "nate": "nathaniel", "nat": "nathaniel", "pat": "patricia",
    "trish": "patricia", "phil": "philip", "filipe": "philip", "becca": "rebecca", "becky": "rebecca", "dick": "richard", "rick": "richard", "rob": "roberto robert", "beto": "roberto", "sam": "samuel",
    "steve": "stephen", "steven": "stephen", "sue": "susan", "susie": "susan", "ted": "theodore", "theo": "theodore", "tom": "thomas", "tommy": "thomas", "tori": "victoria", "vicky": "victoria",
    "bill": "william", "will": "william", "wm": "william", "bob": "robert", "jim": "james", "joe": "joseph", "dan": "daniel", "ben": "benjamin", "tim": "timothy",
}


def name_words(c: Column) -> Column:
    """Words of a name in order, folded, without titles and legal forms, run-together words apart at a capital; empty for a stand-in."""
    apart = F.regexp_replace(c, r"(\p{Ll}|\.)(\p{Lu})", "$1 $2")
    plain = F.trim(F.regexp_replace(fold_marks(apart), "[^a-z]+", " "))
    words = F.filter(F.split(plain, " "), lambda x: (x != "") & ~x.isin(TITLES + LEGAL_FORMS))
    return F.when(c.isNull() | plain.isin(NO_NAMES), F.array().cast("array<string>")).otherwise(words)


def mail_key(c: Column) -> Column:
    """Letters and digits of an address without its +tag; NULL for a stand-in."""
    low = F.regexp_replace(F.lower(c), r"\s", "")
    box = F.split_part(low, F.lit("@"), F.lit(1))
    key = F.nullif(F.regexp_replace(F.regexp_replace(low, r"\+[^@]*@", "@"), "[^a-z0-9]", ""), F.lit(""))
    return F.when(~box.isin(NO_MAILBOXES), key)


def phone_or_null(c: Column) -> Column:
    """Digits of a phone; NULL for fewer than seven or one digit repeated."""
    digits = phone_key_loose(c)
    return F.when((F.length(digits) >= 7) & ~digits.rlike(r"^(\d)\1+$"), digits)


def zip_or_null(c: Column) -> Column:
    """Five digits; a lost leading zero is put back, other lengths are NULL."""
    digits = F.substring(F.regexp_replace(c, r"\D", ""), 1, 5)
    return F.when(F.length(digits) >= 4, F.lpad(digits, 5, "0"))


def prepared(df: DataFrame, record_id: str, *more: str) -> DataFrame:
    """(id, words, mail, phone, zip, more...) of every record with an id; of rows that repeat an id the smallest is taken."""
    fields = ["name", "email", "phone", "zip_code", *more]
    given = spread(df.filter(F.col(record_id).isNotNull()).select(F.col(record_id).alias("id"), *fields), "id").groupBy("id").agg(F.min(F.struct(*fields)).alias("r"))
    return given.select("id", "r.*").select(
        "id", name_words(F.col("name")).alias("words"), mail_key(F.col("email")).alias("mail"), phone_or_null(F.col("phone")).alias("phone"), zip_or_null(F.col("zip_code")).alias("zip"), *more
    )


def formal_words(words: Column) -> Column:
    """Words with short forms of given names spelled out, by the first name each is short for."""
    table = F.create_map(*[F.lit(x) for k, v in SHORT_FORMS.items() for x in (k, v.split()[0])])
    return F.transform(words, lambda w: F.coalesce(table[w], w))


def word_ends(letters: int = 4) -> Column:
    """The suffix and the beginning of every formal word, of `letters` letters; shorter words as they are.

    Suffix index: two words that share any suffix of at least `letters` letters share the one of exactly that length, so only this one is
    indexed; beginnings stand beside suffixes for errors at the end of a word.
    """
    ends = lambda x: F.array(F.concat(F.lit("t"), F.substring(x, -letters, letters)), F.concat(F.lit("h"), F.substring(x, 1, letters)))
    return F.array_distinct(F.flatten(F.transform(F.filter("formal", lambda x: F.length(x) > 1), ends)))


def _key(tag: str, *parts: Column) -> Column:
    """A 64-bit key of parts; NULL where one is missing."""
    return F.when(F.greatest(*[p.isNull().cast("int") for p in parts], F.lit(0)) == 0, F.xxhash64(F.lit(tag), *parts))


#: Parts of the other fields. One slip leaves an end of a field whole; four digits of a phone, so that a swap in its middle breaks neither end.
FIELD_PARTS = {"p1": ("phone", 1, 4), "p2": ("phone", -4, 4), "m1": ("mail", 1, 10), "m2": ("mail", -22, 6), "z1": ("zip", 1, 2), "z2": ("zip", 4, 2)}


def _part(tag: str) -> Column:
    column, at, length = FIELD_PARTS[tag]
    return F.substring(column, at, length)


def _formal(records: DataFrame) -> DataFrame:
    formal = records.withColumn("formal", formal_words(F.col("words")))
    joined = F.array_join(F.array_sort("formal"), "")
    return formal.withColumns({"ends": word_ends(), "initials": F.array_distinct(F.transform("formal", lambda x: F.substring(x, 1, 1))), "joined": F.when(F.size("words") > 0, joined)})


def block_keys(records: DataFrame) -> DataFrame:
    """(id, nameless, kind, key): 64-bit keys under which records meet.

    A suffix (or beginning) of a word is common, and never stands alone: it is refined by an end of the phone or address, or by the initial of
    another word and an end of the zip. The initial of a word stands with an end of the address, and the whole name with an end of the zip, for
    names that are abbreviated or run together. So names spelled differently, and a slip in another field as well, leave a key. Records without a
    name meet others by the whole phone and address (kind 1).
    """
    beside = F.flatten(F.transform(F.filter("formal", lambda x: F.length(x) > 1), lambda x: F.flatten(F.transform(F.filter("formal", lambda y: y != x), lambda y: F.flatten(F.transform(F.array(F.concat(F.lit("t"), F.substring(x, -4, 4)), F.concat(F.lit("h"), F.substring(x, 1, 4))), lambda e: F.array(_key("ei1", e, F.substring(y, 1, 1), _part("z1")), _key("ei2", e, F.substring(y, 1, 1), _part("z2")))))))))
    refined = F.flatten(F.transform("ends", lambda e: F.array(*[_key(f"e{f}", e, _part(f)) for f in ("p1", "p2", "m1", "m2")])))
    boxes = F.flatten(F.transform("initials", lambda i: F.array(_key("im1", i, _part("m1")), _key("im2", i, F.substring("mail", -24, 8)))))
    whole = F.array(_key("nz1", F.col("joined"), _part("z1")), _key("nz2", F.col("joined"), _part("z2")))
    asked = F.array(_key("p", F.col("phone")), _key("m", F.col("mail")))
    of = lambda keys, kind: F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    keyed = _formal(records).select("id", (F.size("words") == 0).alias("nameless"), F.explode(F.array_distinct(F.concat(of(F.concat(refined, beside, boxes, whole), 0), of(asked, 1)))).alias("k"))
    return keyed.select("id", "nameless", "k.kind", "k.key")


def near_keys(records: DataFrame) -> DataFrame:
    """records and their `keys`, for such that something else, such as time, bounds as well: ends of fields and the name alone, and ends of words with the zip or an end of it."""
    zipped = F.flatten(F.transform("ends", lambda e: F.array(*[_key(f"e{f}", e, _part(f)) for f in ("z1", "z2")])))
    alone = F.array(_key("n", F.col("joined")), _key("a1", F.substring("phone", 1, 6)), _key("a2", F.substring("phone", -5, 5)), _key("m1", _part("m1")), _key("m2", F.substring("mail", -24, 8)))
    keys = F.array_distinct(F.filter(F.concat(zipped, alone), lambda k: k.isNotNull()))
    return _formal(records).select(*records.columns, keys.alias("keys"))


def record_parts(records: DataFrame) -> DataFrame:
    """(id, parts): 64-bit hashes of all that common keys are refined by: ends and initials of words, the whole name, and ends of the other fields."""
    each = lambda tag, c: F.transform(c, lambda x: F.xxhash64(F.lit(tag), x))
    fields = [_key(f, _part(f)) for f in FIELD_PARTS]
    single = F.array(_key("n", F.col("joined")), _key("z3", F.substring("zip", 3, 1)), *fields)
    return _formal(records).select("id", F.array_distinct(F.filter(F.concat(each("e", "ends"), each("i", "initials"), single), lambda k: k.isNotNull())).alias("parts"))


#: Records of a block of refined_blocks.
COMMON = 300


def refined_blocks(keys: DataFrame, parts: DataFrame, common: int = COMMON, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(blocks, pivots): keys without any block of more than `common` records, and pairs (a, b) that hold the refined ones together.

    keys: id, nameless, kind, key and whatever else; parts: id, parts. A larger block is refined by every part of its records: a record goes to one smaller block for each.
    A part that more than half of the block shares, among them what the key is made of, tells nothing and is left out of that; the others are refined again until all are
    small, so the rounds follow the logarithm of the largest block. In each refined block, all records are also paired with the smallest id of those with and of those
    without a name, in place of pairing all with all: so the records that differ in no part, or link by the key alone, stay connected. No record is dropped.
    """
    blocks, pivots, level, columns = None, None, keys, keys.columns
    for _ in range(max_rounds):
        large = cut(level.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("nameless"), F.col("id"))).alias("mute"), F.min(F.when(~F.col("nameless"), F.col("id"))).alias("spoken")).filter(F.col("n") > common))
        if large.isEmpty():
            break
        small = without_keys(level, large, "key", "n")
        blocks = small if blocks is None else blocks.unionByName(small)
        rows = cut(join_by_size(level, large.withColumn("_size", F.col("n")), "key", "_size"))
        held = rows.select("id", F.explode(F.array("mute", "spoken")).alias("pivot")).filter(F.col("pivot").isNotNull() & (F.col("pivot") != F.col("id")))
        held = held.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        pivots = held if pivots is None else pivots.unionByName(held)
        asked = rows.join(parts, "id").withColumn("part", F.explode("parts")).withColumn("child", F.xxhash64("key", "part"))
        sizes = cut(asked.groupBy("child").agg(F.count("*").alias("m"), F.first("n").alias("of")).filter((F.col("m") > 1) & (F.col("m") * 2 <= F.col("of"))).select("child", "m"))
        level = cut(join_by_size(asked.drop("key"), sizes, "child", "m").withColumnRenamed("child", "key").select(*columns))
    else:
        raise RuntimeError(f"blocks weren't small after {max_rounds} rounds")
    none = keys.sparkSession.createDataFrame([], "a string, b string")
    return (level if blocks is None else blocks.unionByName(level)), (none if pivots is None else pivots.distinct())


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return (full ^ row).bit_count()


def ratio(a: str, b: str) -> float:
    """2*LCS / total length; 1 for equal texts."""
    return 1.0 if a == b else 2.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


_FORMAL = {k: set(v.split()) | {k} for k, v in SHORT_FORMS.items()}


def _forms(x: str) -> set[str]:
    return _FORMAL.get(x, {x})


def _same_word(x: str, y: str) -> bool:
    return x == y or bool(_forms(x) & _forms(y))


def _spelling(x: str, y: str) -> float:
    """Best ratio of two words or of what they are short for; 0 for very short ones."""
    return max(ratio(p, q) for p in _forms(x) for q in _forms(y)) if min(len(x), len(y)) >= 3 else 0.0


def _abbreviates(x: str, y: str) -> bool:
    """One is the initial of the other, or of what it is short for, or its first letters."""
    x, y = sorted((x, y), key=len)
    return (len(x) == 1 and any(f[0] == x for f in _forms(y) | {y})) or (3 <= len(x) <= 5 and x not in _FORMAL and len(y) >= len(x) + 2 and y.startswith(x))


def mail_ratio(a: str | None, b: str | None) -> float:
    """-1 one is missing; addresses with other digits are other mailboxes, else the ratio."""
    if a is None or b is None:
        return -1.0
    digits = lambda x: [c for c in x if c.isdigit()]
    return ratio(a, b) if digits(a) == digits(b) else 0.0


@lru_cache(maxsize=500_000)
def _letters(text: str) -> int:
    """Counts of letters in unary, 16 bits a letter: the bits in which two texts differ are never more than their insert-delete distance."""
    return sum(((1 << min(text.count(c), 16)) - 1) << 16 * (ord(c) % 32) for c in set(text))


def _letters_allow(x: str, y: str, least: float) -> bool:
    """By its letters, the ratio of two texts can reach `least`."""
    return (_letters(x) ^ _letters(y)).bit_count() <= (1 - least) * (len(x) + len(y)) + 1e-9


@lru_cache(maxsize=500_000)
def _tests(x: str, y: str) -> tuple[bool, bool, bool, bool]:
    """Which tests two words pass: same, spelled alike, roughly alike, abbreviated."""
    alike = _spelling(x, y) if any(_letters_allow(p, q, 0.72) for p in _forms(x) for q in _forms(y)) else 0.0
    return _same_word(x, y), alike >= 0.84, alike >= 0.72, _abbreviates(x, y)


def name_level(a: list[str], b: list[str]) -> int:
    """-1 one is missing, 0 they contradict each other, 1 too little in common, 2 agree by initials or roughly, 3 agree but for spelling, 4 agree."""
    if not len(a) or not len(b):
        return -1
    short, long = (list(a), list(b)) if len(a) <= len(b) else (list(b), list(a))
    count = [0, 0, 0, 0]
    for kind in range(4):
        rest = []
        for x in short:
            hit = next((y for y in long if _tests(x, y)[kind]), None)
            if hit is None:
                rest.append(x)
            else:
                long.remove(hit)
                count[kind] += 1
        short = rest
        if not short:
            break
    sure = count[0] + count[1]
    if (short and (long or not sure)) or (long and not sure):
        # Words that were run together, such as a given name and a surname without a blank. Letters are the same in any order, so they tell first whether an order can do.
        ja, jb = "".join(a), "".join(b)
        near = min(len(ja), len(jb)) >= 8 and _letters_allow(ja, jb, 0.9)
        joined = max(ratio("".join(p), "".join(q)) for p in (sorted(a), list(a)) for q in (sorted(b), list(b), list(b)[::-1])) if near else 0.0
        return 3 if joined >= 0.9 else 0 if short else 1
    if not sure or sum(count) < 2:
        return 1
    if count[2] or count[3]:
        # An initial says little where a whole word of the longer name is left without a partner.
        return 2 if not any(len(y) > 1 for y in long) else 1
    return 3 if count[1] else 4


@lru_cache(maxsize=200_000)
def _names_compared(x: str, y: str) -> tuple[int, float]:
    """Level and ratio of two names, words apart by blanks; the ratio is 0 but for level 1, where alone it is asked for."""
    a, b = x.split(), y.split()
    level = name_level(a, b)
    return level, ratio("".join(sorted(a)), "".join(sorted(b))) if level == 1 else 0.0


@F.pandas_udf(T.StructType([T.StructField("name_level", T.IntegerType()), T.StructField("name_ratio", T.DoubleType()), T.StructField("mail_ratio", T.DoubleType())]))
def compare_words(a: pd.Series, b: pd.Series, ma: pd.Series, mb: pd.Series) -> pd.DataFrame:
    """Arrow-batched comparison of names (words apart by blanks; NULL for such that are known to contradict each other) and addresses; mail_ratio is -1 where one is missing."""
    out = [(*(_names_compared(x, y) if x is not None else (0, 0.0)), mail_ratio(p, q)) for x, y, p, q in zip(a, b, ma, mb)]
    return pd.DataFrame(out, columns=["name_level", "name_ratio", "mail_ratio"]).astype({"name_level": "int32"})


def digits_level(a: Column, b: Column) -> Column:
    """-1 one is missing, 0 differ, 1 one slip apart (a digit more, less or changed, or two neighbours swapped), 2 equal."""
    slips = F.levenshtein(a, b, 2)  # -1 above two
    swapped = (F.length(a) == F.length(b)) & (slips == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.when(a.isNull() | b.isNull(), -1).when(a == b, 2).when(slips.between(0, 1) | swapped, 1).otherwise(0)


def mails_may_agree(ma: Column, mb: Column) -> Column:
    """An upper bound of the ratio of addresses reaches 0.93; false where one is missing."""
    most = F.floor((F.length(ma) + F.length(mb)) * 0.07 + 1e-6).cast("int")
    return F.coalesce(F.call_function("levenshtein", ma, mb, most) >= 0, F.lit(False))


def may_link(a: str, b: str) -> Column:
    """What same_person asks of fields beside the name, by an upper bound of the ratio of addresses: it drops no pair that is linked."""
    mails = mails_may_agree(F.col(f"{a}mail"), F.col(f"{b}mail"))
    return (digits_level(F.col(f"{a}phone"), F.col(f"{b}phone")) >= 1) | (digits_level(F.col(f"{a}zip"), F.col(f"{b}zip")) >= 1) | mails


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, *more: str, linkable: bool = False) -> DataFrame:
    """pairs(a, b) with name_level, mail_level, phone_level, zip_level, and more columns of both sides as a_..., b_...; linkable: only those that may_link.

    Where more has the marks of names, only names that their marks don't rule out go to Python; the others contradict each other."""
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}" if c != "id" else s) for c in ("id", "words", "mail", "phone", "zip", *more)])
    both = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b")
    both = both.filter(may_link("a_", "b_")) if linkable else both
    # Only addresses whose bound reaches the threshold go to Python.
    asked = F.when(mails_may_agree(F.col("a_mail"), F.col("b_mail")), F.col("a_mail"))
    names = F.array_join("a_words", " ") if "w1" not in more else F.when(F.expr(NAMES_MAY), F.array_join("a_words", " "))
    scored = both.withColumn("w", compare_words(names, F.array_join("b_words", " "), asked, "b_mail"))
    mail = F.when(F.col("a_mail").isNull() | F.col("b_mail").isNull(), -1).when(F.col("w.mail_ratio") == 1, 2).when(F.col("w.mail_ratio") >= 0.93, 1).otherwise(0)
    return scored.select(
        "a", "b", F.col("w.name_level").alias("name_level"), F.col("w.name_ratio").alias("name_ratio"), mail.alias("mail_level"),
        digits_level(F.col("a_phone"), F.col("b_phone")).alias("phone_level"), digits_level(F.col("a_zip"), F.col("b_zip")).alias("zip_level"), *[f"{s}_{c}" for s in "ab" for c in more if c not in _MARKS],
    )


def same_person(df: DataFrame) -> DataFrame:
    """Links among compared pairs: names that agree, and one more field that does; without a name, address or phone must."""
    n, m, p, z = (F.col(f"{c}_level") for c in ("name", "mail", "phone", "zip"))
    named = (n >= 3) & ((m >= 1) | (p >= 1) | (z >= 1))
    initials = (n == 2) & ((m >= 1) | (p >= 1) | (z == 2))
    nameless = (n == -1) & (((m == 2) & (p != 0)) | ((p == 2) & (m != 0)) | ((m == 2) & (z == 2)) | ((p == 2) & (z == 2)))
    partly = (n == 1) & (((m >= 1) & (p >= 1)) | ((F.col("name_ratio") >= 0.7) & ((m >= 1) | (p >= 1)) & (z >= 1)))
    return df.filter(named | initials | nameless | partly)


#: Rows of one block that meet in one task; larger blocks are met tile by tile.
TILE = 4096
#: Counts of rows are kept by so many remainders of keys, so that finding the large blocks moves little.
BUCKETS = 1 << 20


def meet(rows: DataFrame, condition: str, left: str = "true", right: str = "true", tile: int = TILE) -> DataFrame:
    """Distinct (a, b), the `no` of all pairs of rows (key, no, ...) with one key for which condition holds; a is of the rows that `left` holds for, b of `right`.

    condition: SQL over a_... and b_...; it is part of the join, so pairs it doesn't hold for are never written. No block is capped: a key with more than `tile` rows, or that shares
    a bucket with such a one, is cut into tiles of that size, and each tile of the left meets each of the right in a group of its own. The result is the same for any tile.
    """
    rows = rows.withColumn("_bucket", F.pmod("key", F.lit(BUCKETS)))
    large = cut(rows.groupBy("_bucket").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("_bucket", F.ceil(F.col("n") / tile).cast("int").alias("_tiles")))
    side = lambda df, s, *on: df.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c not in ("key", "_bucket")])
    pairs = lambda x, y, *on: x.join(y.hint("merge"), [*on]).filter(condition).select("a_no", "b_no")
    crowds = not large.isEmpty()
    small = rows.join(F.broadcast(large.select("_bucket")), "_bucket", "left_anti") if crowds else rows
    met = pairs(side(small.filter(left), "a", "key"), side(small.filter(right), "b", "key"), "key")
    if crowds:
        tiled = cut(rows.join(F.broadcast(large), "_bucket")).withColumn("_own", F.pmod(F.xxhash64("no"), F.col("_tiles"))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        of = lambda kept, s, i, j: side(tiled.filter(kept).withColumns({"_i": F.col(i).cast("long"), "_j": F.col(j).cast("long")}).drop("_tiles", "_own", "_other"), s, "key", "_i", "_j")
        met = met.unionByName(pairs(of(left, "a", "_own", "_other"), of(right, "b", "_other", "_own"), "key", "_i", "_j"))
    return met.distinct().select(F.col("a_no").alias("a"), F.col("b_no").alias("b"))


_LETTERS = (1 << 52) - 1
_MARKS = ("w1", "w2", "w3", "wj")
# Classes of initials, two of five bits each, so that none holds another.
_INITIALS = [sum(1 << b for b in two) << 58 for two in combinations(range(5), 2)]


def _mark(text: str) -> int:
    """Counts of letters in unary, two bits a letter."""
    return sum((1 if text.count(c) == 1 else 3) << 2 * (ord(c) - 97) for c in set(text) if "a" <= c <= "z")


@lru_cache(maxsize=200_000)
def _word_mark(word: str) -> int:
    """Letters, length up to 63, and the class of the initial."""
    return _mark(word) | len(word) << 52 | _INITIALS[ord(word[0]) % len(_INITIALS)]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in _MARKS]))
def name_marks(names: pd.Series) -> pd.DataFrame:
    """Letters, length and initial of up to three words, the first again where there are fewer, and letters and length of the whole name; w1 is -1 where they can't tell, as for longer names and short forms."""
    out = []
    for name in names:
        words = name.split()
        if not 0 < len(words) < 4 or any(len(w) > 63 or w in _FORMAL for w in words):
            out.append((-1, 0, 0, 0))
        else:
            marks, joined = [_word_mark(w) for w in words], "".join(words)
            out.append((*(marks + marks[:1] * 2)[:3], _mark(joined) | len(joined) << 52))
    return pd.DataFrame(out, columns=list(_MARKS))


@F.pandas_udf(T.LongType())
def mail_mark(mails: pd.Series) -> pd.Series:
    """Letters of an address, and its length up to 1023."""
    return pd.Series([None if m is None else _mark(m) | min(len(m), 1023) << 52 for m in mails], dtype="Int64")


@F.pandas_udf(T.LongType())
def phone_mark(phones: pd.Series) -> pd.Series:
    """Counts of digits in unary, six bits a digit: a slip changes two of them at most, a swap none."""
    return pd.Series([None if p is None else sum(((1 << min(p.count(d), 6)) - 1) << 6 * int(d) for d in set(p) if d in "0123456789") for p in phones], dtype="Int64")


def zip_mark(c: Column) -> Column:
    """The five digits, four bits each, and above them how often each occurs, three bits a digit."""
    digits = [F.ascii(F.substring(c, k, 1)) - 48 for k in range(1, 6)]
    return sum((F.shiftleft(d.cast("long"), 4 * k) for k, d in enumerate(digits)), F.lit(0)) + sum((F.call_function("shiftleft", F.lit(1).cast("long"), 3 * d + 20) for d in digits), F.lit(0))


def _near(x: str, y: str, share: int, bits: int = 63) -> str:
    """By their marks, x and y may lie within an insert-delete distance of `share` hundredths of their lengths, which are kept above the letters in `bits`."""
    return f"bit_count(({x} ^ {y}) & {_LETTERS}L) * 100 <= {share} * ((shiftright({x}, 52) & {bits}L) + (shiftright({y}, 52) & {bits}L))"


def _names_may(share: int, abbreviated: bool) -> str:
    """SQL over the marks of two names: false only if some word of either name has no partner in the other by `share` or as an abbreviation, and run together they aren't alike.

    What abbreviates a word has its initial, and no letter that the word lacks. It stays small, for the JVM compiles no method of 8,000 bytes or more.
    """
    words = _MARKS[:3]
    within = _LETTERS | 31 << 58
    short = lambda x, y: f" OR {x} & ~{y} & {within}L = 0 OR {y} & ~{x} & {within}L = 0" if abbreviated else ""
    partner = lambda x, y: f"({_near(x, y, share)}{short(x, y)})"
    all_of = lambda s, t: "(" + " AND ".join("(" + " OR ".join(partner(f"{s}_{x}", f"{t}_{y}") for y in words) + ")" for x in words) + ")"
    return f"(a_w1 = -1 OR b_w1 = -1 OR {_near('a_wj', 'b_wj', 10, 1023)} OR {all_of('a', 'b')} OR {all_of('b', 'a')})"


#: False only if name_level is 0: above it, every word of the shorter name has a partner in the longer, or the names run together are alike.
NAMES_MAY = _names_may(28, True)
#: False only if name_level is 2 or less: above it, all partners are the same word or spelled alike.
NAMES_AGREE = _names_may(16, False)
PHONES_MAY = "bit_count(a_v ^ b_v) <= 2"
MAILS_MAY = f"(shiftright(a_v, 52) & 1023L = 1023L OR shiftright(b_v, 52) & 1023L = 1023L OR {_near('a_v', 'b_v', 7, 1023)})"
_NIBBLES = "((a_v ^ b_v) & 1048575L)"
ZIPS_MAY = f"(shiftright(a_v, 20) = shiftright(b_v, 20) OR bit_count(({_NIBBLES} | shiftright({_NIBBLES}, 1) | shiftright({_NIBBLES}, 2) | shiftright({_NIBBLES}, 3)) & 69905L) <= 1)"


def with_marks(records: DataFrame) -> DataFrame:
    """records with a number `no` and the marks by which pairs are told apart before they are made."""
    marks = records.withColumn("no", F.monotonically_increasing_id()).withColumns({"m": name_marks(F.array_join("words", " ")), "mail_mark": mail_mark("mail")})
    return marks.select("*", *[F.coalesce(f"m.{c}", F.lit(0)).alias(c) for c in _MARKS]).drop("m")


def marked(records: DataFrame) -> DataFrame:
    """records with a number `no`, formal words and all marks."""
    return cut(_formal(with_marks(records).withColumns({"phone_mark": phone_mark("phone"), "zip_mark": F.when(F.col("zip").isNotNull(), zip_mark(F.col("zip")))})))


def phone_keys() -> Column:
    """Two phones within a slip or a swap of each other share one of these: an end of five digits, or of four or three for short ones, or all digits in any order."""
    size = F.length("phone")
    ends = lambda tag, n: [_key(f"{tag}{n}", F.substring("phone", 1, n)), _key(f"{tag}-{n}", F.substring("phone", -n, n))]
    short = [F.when(size <= most, k) for most, n in ((9, 4), (7, 3)) for k in ends("a", n)]
    return F.array(*ends("a", 5), *short, _key("s", F.array_join(F.array_sort(F.split("phone", "")), "")))


def mail_keys() -> Column:
    """The beginning of an address, or letters before the last 16 with an initial or the end of a word; all with its digits, which are equal where addresses agree."""
    digits = F.regexp_replace("mail", "[^0-9]", "")
    tails = F.transform(F.filter("formal", lambda x: F.length(x) > 1), lambda x: F.substring(x, -4, 4))
    return F.concat(F.array(_key("m1", _part("m1"), digits)), F.transform("initials", lambda i: _key("im2", i, _part("m2"), digits)), F.transform(F.array_distinct(tails), lambda e: _key("tm2", e, _part("m2"), digits)))


def zip_keys() -> Column:
    """An end of a word with the initial of another, or the whole name, with an end of the zip."""
    long = lambda f: F.flatten(F.transform(F.filter("formal", lambda x: F.length(x) > 1), f))
    others = lambda x, f: F.flatten(F.transform(F.array_distinct(F.transform(F.filter("formal", lambda y: y != x), lambda y: F.substring(y, 1, 1))), f))
    ends = lambda x: (F.concat(F.lit("t"), F.substring(x, -4, 4)), F.concat(F.lit("h"), F.substring(x, 1, 4)))
    beside = long(lambda x: others(x, lambda i: F.array(*[_key(f"ei{z}", e, i, _part(z)) for e in ends(x) for z in ("z1", "z2")])))
    return F.concat(beside, F.array(_key("nz1", F.col("joined"), _part("z1")), _key("nz2", F.col("joined"), _part("z2"))))


def _marked_pairs(records: DataFrame, tile: int) -> DataFrame:
    """Distinct (a, b) of the numbers of marked records that share a key of a pass and may be linked by it."""
    named = records.filter(F.size("words") > 0)
    keyed = lambda df, keys, *cols: df.withColumn("key", F.explode(F.array_distinct(keys))).filter(F.col("key").isNotNull()).select("key", "no", *cols)
    once = "a_no < b_no AND "
    passes = [("phone_mark", phone_keys(), PHONES_MAY), ("mail_mark", mail_keys(), MAILS_MAY), ("zip_mark", zip_keys(), ZIPS_MAY)]
    found = []
    for v, keys, near in passes:
        found.append(cut(meet(keyed(named.filter(F.col(v).isNotNull()), keys, F.coalesce(v, F.lit(0)).alias("v"), *_MARKS), f"{once}{near} AND {NAMES_MAY}", tile=tile)))
        release(records.sparkSession)
    # Without a name, phone or address are equal, and no other field speaks against it, or the zip is equal too.
    mute = records.withColumns({"mute": F.size("words") == 0, "p": _key("p", F.col("phone")), "m": _key("m", F.col("mail"))})
    equal = "((a_p = b_p AND coalesce(a_m = b_m, true)) OR (a_m = b_m AND coalesce(a_p = b_p, true)) OR a_zip_mark = b_zip_mark OR (a_m = b_m AND a_phone_mark IS NOT NULL AND bit_count(a_phone_mark ^ b_phone_mark) <= 2))"
    silent = meet(keyed(mute, F.array("p", "m"), "mute", "p", "m", "zip_mark", "phone_mark"), f"(a_no < b_no OR NOT b_mute) AND a_no <> b_no AND {equal}", left="mute", tile=tile)
    found.append(silent.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def candidate_pairs(records: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct (a, b), a < b, of all records that share a key of a pass and may be linked by what the pass is for; the same for any tile.

    Three passes follow the three fields of which same_person asks one: phone, address, and zip with parts of the name. A pass leaves out only pairs that its field or the names rule out.
    Where a phone or address stands alone, one of the two has no name.
    """
    known = marked(records)
    named = lambda s: known.select(F.col("no").alias(s), F.col("id").alias(f"{s}_id"))
    met = _marked_pairs(known, tile).join(named("a"), "a").join(named("b"), "b")
    return met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def different_texts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, copies): one record for each text, the one with the smallest id, and (id, text, copies) of all records with that id and the number of their copies.

    Copies are records that agree in all prepared fields. They are reduced in each task first, so a text with a third of all rows moves as one row per task.
    """
    same = [x for c in ("words", "mail", "phone", "zip") for x in (F.col(c).isNull(), F.col(c))]
    hashed = records.withColumns({"_h1": F.xxhash64(F.lit(1), *same), "_h2": F.xxhash64(F.lit(2), *same)}).withColumn("_h", F.struct("_h1", "_h2"))
    least = cut(hashed.groupBy("_h").agg(F.min("id").alias("text"), F.count("*").alias("copies")).withColumn("_size", F.col("copies")))
    copies = cut(join_by_size(hashed.select("id", "_h"), least, "_h", "_size").drop("_h"))
    return records.join(copies.filter(F.col("id") == F.col("text")).select("id"), "id", "left_semi"), copies


def entity_links(df: DataFrame, record_id: str) -> DataFrame:
    """(a, b), a <= b, of texts found to be of the same person or firm by their own fields; (a, a) where a text with several copies says enough to link them."""
    return _links(*different_texts(cut(prepared(df, record_id)))).filter("a < b")


def _links(texts: DataFrame, copies: DataFrame, tile: int = TILE) -> DataFrame:
    known = marked(texts)
    release(known.sparkSession)
    by_no = known.select(F.col("no").alias("id"), F.col("id").alias("text"), "words", "mail", "phone", "zip")
    twice = copies.filter((F.col("copies") > 1) & (F.col("id") == F.col("text"))).select("text").join(by_no, "text").select(F.col("id").alias("a"), F.col("id").alias("b"))
    pairs = cut(_marked_pairs(known, tile).unionByName(twice))
    release(known.sparkSession)
    linked = same_person(compared(pairs, by_no, by_no, "text", linkable=True))
    return linked.select(F.least("a_text", "b_text").alias("a"), F.greatest("a_text", "b_text").alias("b"))


def entities(df: DataFrame, record_id: str, tile: int = TILE) -> DataFrame:
    """One row (record_id, entity_id, links) per record: its group of all that is linked directly or indirectly, and to how many different texts its own is linked directly.

    Copies (records that agree in all fields as they are compared) are compared as one text and follow it, unless the text is linked to nothing and says too little to
    link its copies. A record that is linked to none is a group of its own with 0 links. Records with a NULL id are left out, repeated ids count once;
    missing names, addresses, phones or zip codes just give no key. An empty table gives no rows.
    """
    texts, copies = different_texts(cut(prepared(df, record_id)))
    found = cut(_links(texts, copies, tile))
    release(found.sparkSession)
    links = found.filter("a < b")
    grouped = hash_to_min(found, "a", "b").withColumnsRenamed({"node": "text", "group_key": "entity"})
    counted = links.select(F.explode(F.array("a", "b")).alias("text")).groupBy("text").agg(F.count("*").alias("links"))
    known = cut(grouped.join(counted, "text", "left").join(copies.filter(F.col("id") == F.col("text")).select("text", F.col("copies").alias("_size")), "text"))
    linked = join_by_size(copies.select("id", "text"), known, "text", "_size").select("id", "entity", "links")
    alone = copies.join(linked.select("id"), "id", "left_anti").select("id", F.col("id").alias("entity"), F.lit(0).cast("long").alias("links"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(record_id), F.col("entity").alias("entity_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def entity_pairs(grouped: DataFrame, record_id: str) -> DataFrame:
    """(record_id_a, record_id_b), smaller first, of all records of the same group: the pairs asked for, so as many as the groups have."""
    side = lambda s: grouped.select("entity_id", F.col(record_id).alias(f"{record_id}_{s}"))
    return side("a").join(side("b"), "entity_id").filter(F.col(f"{record_id}_a") < F.col(f"{record_id}_b")).select(f"{record_id}_a", f"{record_id}_b")
