"""Freely typed values mapped to the closest entry of a reference list, in built-in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import fold_marks
from tidemill.operators.skew import join_by_size, spread
from tidemill.session import cut

# Words put around a genre that don't belong to its name, and small words between its parts.
TAG_WRAPPERS = ["modern", "female", "80s", "love", "best", "of", "classic", "classics", "pure", "instrumental", "old", "music", "4ever", "br", "n", "and", "e", "y", "und", "et"]
# Words around a lead source that don't belong to its name.
SOURCE_WRAPPERS = ["paid", "media", "found", "on", "the", "by", "monthly", "incoming", "saw", "in", "next", "door", "see", "notes", "a", "our", "via", "from", "at", "my", "of", "through", "made"]

VOWELS = "[aeiou]"
#: Words of an entry up to which every choice of them is a form.
ALL_SUBSETS = 10


def tokens(c: Column) -> Column:
    """Words of letters and digits, folded and in lower case."""
    return F.filter(F.split(fold_marks(c), "[^a-z0-9]+"), lambda x: x != "")


# Words that stand for a word of a lead source.
SOURCE_SYNONYMS = {"website": "web", "telephone": "phone", "organically": "organic", "online": "web"}


def limit_for(length: Column) -> Column:
    """Edits (insert, delete, replace) allowed against a spelled-out entry of `length` letters; a swap of neighbours takes two."""
    return F.when(length <= 3, 0).when(length <= 7, 2).when(length <= 10, 3).otherwise(4)


def slips_for(length: Column) -> Column:
    """Slips of the hand allowed, where a swap of neighbours is one slip."""
    return F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 10, 2).when(length <= 13, 3).otherwise(4)


def limit_for_short(length: Column) -> Column:
    """Edits allowed against an abbreviated entry."""
    return F.when(length <= 5, 0).when(length <= 9, 1).otherwise(2)


def slips(edits: Column, a: Column, b: Column) -> Column:
    """The least number of slips behind so many edits: letters that only changed places took one slip for two edits."""
    left_over = F.aggregate(F.split(a, ""), b, lambda rest, ch: F.regexp_replace(rest, F.concat(F.lit("^([^"), ch, F.lit("]*)"), ch), F.lit("$1")))
    common = F.length(b) - F.length(left_over)
    return F.greatest(F.greatest(F.length(a), F.length(b)) - common, F.ceil(edits / 2)).cast("int")


def reference_forms(reference: DataFrame, entry: str, subsets: bool) -> DataFrame:
    """(canonical, form, k, cost): the ways in which an entry may be written, before any typing error.

    Its words in turned and reversed order, some of its words only (if `subsets`; of more than ALL_SUBSETS words, all or all but one), one word cut to its first letters or
    without its inner vowels, all words without vowels, and leading words as initials. A form that fits several
    entries equally well names none and is left out. An entry as a whole may be of any length; a part of it has three letters or more, an abbreviation five,
    as shorter ones would be met by chance.
    """
    def cut_to(letters: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda p: F.array_join(F.transform("w", lambda x, i: F.when(i == p, F.substring(x, 1, letters)).otherwise(x)), ""))

    # Words joined by a hyphen are also taken as one, as they are when abbreviated.
    whole = F.filter(F.transform(F.split(fold_marks(F.col(entry)), r"\s+"), lambda x: F.regexp_replace(x, "[^a-z0-9]", "")), lambda x: x != "")
    base = reference.filter(F.col(entry).isNotNull()).select(F.col(entry).alias("canonical"), F.explode(F.array_distinct(F.array(tokens(F.col(entry)), whole))).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    chosen = base.select("canonical", n.alias("n"), "w")
    if subsets:
        masks = F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 1).cast("int"))
        short = chosen.filter(F.size("w") <= ALL_SUBSETS).select("canonical", "n", "w", F.explode(masks).alias("mask")).select(
            "canonical", "n", F.filter("w", lambda x, i: F.expr("mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0).alias("w")
        )
        without = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.filter("w", lambda x, i: i != p))
        long = chosen.filter(F.size("w") > ALL_SUBSETS).select("canonical", "n", F.explode(F.concat(F.array("w"), without)).alias("w"))
        chosen = short.unionByName(long)
    turned = chosen.select("canonical", "n", F.posexplode(F.array(F.col("w"), F.reverse("w"))).alias("back", "w")).select("canonical", "n", "w", "back", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("r"))
    moved = F.when((F.col("back") == 0) & (F.col("r") == 0), 0.0).otherwise(0.1)
    ordered = turned.select("canonical", "n", F.concat(F.expr("slice(w, r + 1, size(w))"), F.expr("slice(w, 1, r)")).alias("w"), moved.alias("moved")).groupBy("canonical", "n", "w").agg(F.min("moved").alias("moved"))
    missing = (F.col("n") - F.size("w")) * F.lit(0.2) + F.col("moved")
    bare = lambda x: F.concat(F.substring(x, 1, 1), F.regexp_replace(F.regexp_replace(x, "^.", ""), VOWELS, ""))
    cut_one = [cut_to(q) for q in (1, 2, 3, 4, 5)]
    bare_one = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda p: F.array_join(F.transform("w", lambda x, i: F.when(i == p, bare(x)).otherwise(x)), ""))
    bare_all = F.array(F.array_join(F.transform("w", bare), ""))
    initials = F.array(F.array_join(F.transform("w", lambda x, i: F.when(i < F.size("w") - 1, F.substring(x, 1, 1)).otherwise(x)), ""))
    spelled = ordered.filter((F.size("w") == F.col("n")) | (F.length(F.array_join("w", "")) >= 3)).select("canonical", F.array_join("w", "").alias("form"), missing.alias("cost"), F.lit(False).alias("short"))
    shortened = ordered.select("canonical", F.explode(F.concat(*cut_one, bare_one, bare_all, initials)).alias("form"), (missing + 0.6).alias("cost"), F.lit(True).alias("short")).filter(F.length("form") >= 5)
    forms = spelled.union(shortened).groupBy("form", "canonical").agg(F.min(F.struct("cost", "short")).alias("best"))
    by_cost = Window.partitionBy("form").orderBy("best.cost", "canonical")
    ranked = forms.select("form", "canonical", "best.cost", "best.short", F.row_number().over(by_cost).alias("rank"), F.lead("best.cost").over(by_cost).alias("next"))
    limit = F.when(F.col("short"), limit_for_short(F.length("form"))).otherwise(limit_for(F.length("form")))
    # The list is fixed and small, and its forms are asked for again and again: they are written once.
    return cut(ranked.filter("rank = 1 AND (next IS NULL OR next > cost)").select("canonical", "form", limit.alias("k"), "cost"))


def value_forms(values: DataFrame, wrappers: list[str], synonyms: dict[str, str]) -> DataFrame:
    """(value, typed, vcost): the words of a value run together, as they are, without wrapping words and numbers, and with synonyms put in."""
    words = values.select("value", tokens(F.col("value")).alias("w"))
    long_ones = F.array(*[F.lit(x) for x in wrappers if len(x) >= 4]).cast("array<string>")
    is_wrapper = lambda x: x.isin(wrappers) | x.rlike("^[0-9]+$") | ((F.length(x) >= 4) & F.exists(long_ones, lambda s: F.levenshtein(x, s) <= F.when(F.length(s) >= 6, 2).otherwise(1)))
    stripped = F.filter("w", lambda x: ~is_wrapper(x))
    swaps = F.create_map(*[F.lit(x) for pair in (synonyms or {"": ""}).items() for x in pair])
    swapped = F.transform(stripped, lambda x: F.coalesce(swaps[x], x))
    form = lambda w, cost: F.struct(F.array_join(w, "").alias("typed"), F.lit(cost).alias("cost"))
    both = words.select("value", F.explode(F.array(form("w", 0.0), form(stripped, 0.3), form(swapped, 0.5))).alias("f"))
    return both.groupBy("value", F.col("f.typed").alias("typed")).agg(F.min("f.cost").alias("vcost")).filter(F.length("typed") > 0)


def map_values(values: DataFrame, reference: DataFrame, entry: str, wrappers: list[str], subsets: bool, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(value, canonical_value, score) for the distinct texts in values.value; '' and NULL where none is meant.

    Pigeonhole join: a form of length L with k allowed edits is cut into k+1 segments, one of which stays whole in anything within
    k edits, shifted by k places at most. Values join on (L, k, segment number, substring) and are then verified
    by levenshtein, a swap of neighbours being one slip. Of several entries the least slips and cost win, then the smaller text. Values that matched none are added
    by an anti-join. NULL values are left out; blank ones name none; an empty reference makes all values name none.
    """
    forms = reference_forms(reference, entry, subsets)
    cuts = forms.select("canonical", "form", "k", "cost", F.length("form").alias("L"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).select(
        "canonical", "form", "k", "cost", "L", "i", F.expr("substring(form, (i * L) div (k + 1) + 1, ((i + 1) * L) div (k + 1) - (i * L) div (k + 1))").alias("segment")
    )
    all_values = values.filter(F.col("value").isNotNull()).select("value").distinct()
    # Few bytes, but each value asks with some hundred substrings: without this, one task would make them all.
    typed = spread(value_forms(all_values, wrappers, synonyms or {}), "value", "typed")
    near = typed.withColumn("len", F.length("typed")).select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("len") - 4), F.col("len") + 4)).alias("L"))
    asked = near.select("*", F.explode(F.array_distinct(F.array(limit_for(F.col("L")), limit_for_short(F.col("L"))))).alias("k")).filter("abs(len - L) <= k")
    asked = asked.select("*", F.explode(F.expr("sequence(0, k)")).alias("i")).select("*", F.explode(F.expr("sequence(-k, k)")).alias("shift"))
    asked = asked.withColumn("at", F.expr("(i * L) div (k + 1) + 1 + shift")).withColumn("size", F.expr("((i + 1) * L) div (k + 1) - (i * L) div (k + 1)")).filter("at >= 1 AND at + size - 1 <= len")
    asked = asked.select("value", "typed", "vcost", "L", "k", "i", F.expr("substring(typed, at, size)").alias("segment")).distinct()
    candidates = asked.join(cuts, ["L", "k", "i", "segment"]).select("value", "typed", "vcost", "canonical", "form", "k", "cost").distinct()
    edits = F.expr("levenshtein(typed, form, k)")
    near_enough = candidates.withColumn("edits", edits).filter("edits >= 0").withColumn("slips", slips(F.col("edits"), F.col("typed"), F.col("form"))).filter(F.col("slips") <= slips_for(F.length("form")))
    scored = near_enough.withColumn("score", F.col("slips") + F.col("cost") + F.col("vcost"))
    best = scored.groupBy("value").agg(F.min(F.struct("score", "canonical")).alias("b")).select("value", F.col("b.canonical").alias("canonical_value"), F.col("b.score").alias("score"))
    best = cut(best)
    unmatched = all_values.join(best, "value", "left_anti").select("value", F.lit("").alias("canonical_value"), F.lit(None).cast("double").alias("score"))
    return best.unionByName(unmatched)


def map_rows(rows: DataFrame, reference: DataFrame, entry: str, wrappers: list[str], subsets: bool, synonyms: dict[str, str] | None = None) -> DataFrame:
    """rows(row_key, value) with canonical_value and score; rows with a NULL value are left out.

    Each distinct text is mapped once; a text with a third of all rows is joined back by broadcast.
    """
    counted = rows.filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    mapped = cut(map_values(counted.select("value"), reference, entry, wrappers, subsets, synonyms).join(counted, "value"))
    return join_by_size(rows, mapped, "value", "n")


def lead_source_rows(crm_leads: DataFrame, ref_lead_source: DataFrame) -> DataFrame:
    """Rows of crm_leads whose source is neither blank nor literally an entry."""
    typed = crm_leads.filter(F.trim("source") != "").select(F.col("crm_record_id").alias("row_key"), F.col("source").alias("value"))
    return typed.join(ref_lead_source.select(F.col("canonical_source").alias("value")), "value", "left_anti").select("row_key", "value")


def unresolved_tag_rows(dim_tag_taxonomy: DataFrame) -> DataFrame:
    """Tags that no earlier step classified."""
    return dim_tag_taxonomy.filter(F.col("classification_method") == "unresolved").select(F.col("tag_norm").alias("row_key"), F.col("tag_norm").alias("value"))
