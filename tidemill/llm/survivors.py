"""One surviving record of each group of duplicates, field by field, by a latent two-sided quality model of the sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.skew import join_by_size
from tidemill.session import cut

# Traces of text that was decoded wrongly, of text that was cut short, and the form of an mbid.
GARBLED = "�|[\u0080-\u009f]|Ã[\u0080-¿]|Â[\u0080-¿]|â[\u0080-¿€]|&#\\d+;"
CUT_SHORT = r"(…|\.\.+|\([^)]*|\[[^\]]*)\s*$"
MBID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
#: Sources of a field in the order of their votes, each with what is believed of it at first: (sensitivity, specificity).
NAME_SOURCES = {"first_keyed_tracks": (0.95, 0.95), "first_keyed_albums": (0.95, 0.95), "other_records": (0.8, 0.8), "other_groups": (0.9, 0.6), "writing": (0.95, 0.5)}
MBID_SOURCES = {"usual_form_tracks": (0.95, 0.95), "usual_form_albums": (0.95, 0.95), "usual_length": (0.95, 0.8), "other_groups": (0.9, 0.6), "other_digits": (0.95, 0.5)}
#: Answers that the first belief counts as much as, of sources not described, and the share of true values with the same weight.
WEIGHT, BELIEF, TRUE_SHARE = 20.0, (0.8, 0.8), 0.6
#: Groups of duplicates in which a value may stand before the source `other_groups` denies it.
GROUPS_OF_ONE_VALUE = 2


def folded(c: Column) -> Column:
    """A value as claims are compared: outer blanks and letter case don't matter; NULL where nothing is left."""
    return F.lower(F.nullif(F.trim(c), F.lit("")))


def words_of(c: Column) -> Column:
    """Distinct words of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1))


def fit_sources(votes: np.ndarray, counts: np.ndarray, beliefs: list[tuple[float, float]] | None = None, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over patterns of votes: (probability that a value with the pattern is true, sensitivity and specificity of each source).

    votes: patterns x sources of 1 (asserts the value), 0 (knows the record but denies the value) or -1 (no word); counts: values with each pattern.
    Sensitivity is the share of true values that a source asserts, specificity the share of false ones that it denies. Both start from a belief that
    counts as much as WEIGHT answers, so in all but tiny tables the agreement between sources decides which of them are good.
    """
    yes, no = (votes == 1).astype(float), (votes == 0).astype(float)
    sens0, spec0 = np.array(beliefs or [BELIEF] * votes.shape[1]).T
    sens, spec = sens0, spec0
    share, posterior = TRUE_SHARE, np.zeros(len(votes))
    for _ in range(rounds):
        true = np.log(share) + yes @ np.log(sens) + no @ np.log(1 - sens)
        false = np.log(1 - share) + yes @ np.log(1 - spec) + no @ np.log(spec)
        new = 1 / (1 + np.exp(np.clip(false - true, -500, 500)))
        t, f = new * counts, (1 - new) * counts
        sens = (t @ yes + sens0 * WEIGHT) / (t @ (yes + no) + WEIGHT)
        spec = (f @ no + spec0 * WEIGHT) / (f @ (yes + no) + WEIGHT)
        share = (t.sum() + TRUE_SHARE * WEIGHT) / (counts.sum() + WEIGHT)
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return posterior, sens, spec


def judged(values: DataFrame, votes: list[Column], sources: dict[str, tuple[float, float]]) -> DataFrame:
    """values with `posterior`. Only the counts of vote patterns reach the driver: 3^n at most for n sources, whatever the number of values."""
    voted = cut(values.withColumn("_votes", F.concat_ws(",", *[v.cast("string") for v in votes])))
    patterns = sorted((r["_votes"], r["count"]) for r in voted.groupBy("_votes").count().collect())
    if not patterns:
        return voted.drop("_votes").withColumn("posterior", F.lit(0.0))
    posterior, _, _ = fit_sources(np.array([[int(v) for v in p.split(",")] for p, _ in patterns]), np.array([n for _, n in patterns], float), list(sources.values()))
    table = F.create_map(*[F.lit(x) for (p, _), q in zip(patterns, posterior) for x in (p, float(q))])
    return voted.withColumn("posterior", table[F.col("_votes")]).drop("_votes")


def claims_of(df: DataFrame, record_id: str, name: str, keyed: str, mbid: str, origin: str = "tracks") -> DataFrame:
    """(dup_group, id, name, keyed, mbid, latest, plays, origin) of the duplicates in df; rows without a group are none."""
    return df.filter(F.col("dup_group").isNotNull()).select(
        "dup_group", F.col(record_id).alias("id"), F.col(name).alias("name"), F.col(keyed).alias("keyed"), F.col(mbid).alias("mbid"), F.col("latest_scrobble_at").alias("latest"), F.col("scrobble_count").alias("plays"), F.lit(origin).alias("origin")
    )


def field_values(claims: DataFrame) -> DataFrame:
    """(field, dup_group, value, vkey, records, origin, sample, groups): the distinct values of both fields in each group, one spelling of each, and in how many groups it stands.

    A value that stands in a third of all groups is spread (see join_by_size). The table is written once, as everything else is derived from it.
    """
    one = lambda field: claims.select(F.lit(field).alias("field"), "dup_group", folded(F.col(field)).alias("value"), F.col(field).alias("sample"), "origin")
    given = one("name").unionByName(one("mbid")).filter(F.col("value").isNotNull())
    values = given.groupBy("field", "dup_group", "value").agg(F.count("*").alias("records"), F.min("origin").alias("origin"), F.min("sample").alias("sample"))
    values = cut(values.withColumns({"vkey": F.xxhash64("field", "dup_group", "value"), "everywhere": F.xxhash64("field", "value")}))
    counted = cut(values.groupBy("everywhere").agg(F.count("*").alias("groups")).withColumn("_size", F.col("groups")))
    return cut(join_by_size(values, counted, "everywhere", "_size").drop("everywhere"))


def _by_origin(origin: str, answer: Column) -> Column:
    return F.when(F.col("origin") == origin, answer).otherwise(-1)


def name_values(claims: DataFrame, values: DataFrame) -> DataFrame:
    """The name values of each group with their posterior.

    A value is asserted or denied by five sources: the texts under which the group's records were first keyed (of tracks and of albums, each
    with a quality of its own), the group's other records (they know most of the value's words), the other groups (a name of one recording isn't
    found in many), and the writing, which only tells traces of wrong decoding or cutting. A source that knows nothing of the group has no word.
    """
    names = values.filter("field = 'name'")
    keyed = claims.select("dup_group", folded(F.col("keyed")).alias("value")).filter(F.col("value").isNotNull()).groupBy("dup_group", "value").agg(F.lit(True).alias("keyed_so"))
    known = keyed.groupBy("dup_group").agg(F.lit(True).alias("keyed_any"))
    # Other records: how many of the value's words stand in another value of the group as well. Repetitions of one value are no second opinion.
    worded = cut(names.select("vkey", F.explode(words_of(F.col("value"))).alias("word"), "dup_group").select("vkey", F.xxhash64("dup_group", "word").alias("wkey")))
    carriers = cut(worded.groupBy("wkey").agg(F.count("*").alias("carriers")).withColumn("_size", F.col("carriers")))
    met = join_by_size(worded, carriers, "wkey", "_size").groupBy("vkey").agg(F.count("*").alias("words"), F.count_if(F.col("carriers") > 1).alias("shared"))
    sizes = names.groupBy("dup_group").agg(F.count("*").alias("named"))
    names = names.join(keyed, ["dup_group", "value"], "left").join(known, "dup_group", "left").join(sizes, "dup_group").join(met, "vkey", "left")
    said = F.when(F.col("named") < 2, -1).otherwise((2 * F.coalesce("shared", F.lit(0)) >= F.greatest(F.coalesce("words", F.lit(1)), F.lit(1))).cast("int"))
    keyed_vote = F.when(F.col("keyed_any").isNull(), -1).otherwise(F.col("keyed_so").isNotNull().cast("int"))
    writing = (~F.col("sample").rlike(GARBLED) & ~F.col("sample").rlike(CUT_SHORT) & F.col("sample").rlike(r"\p{L}.*\p{L}")).cast("int")
    votes = [_by_origin("tracks", keyed_vote), _by_origin("albums", keyed_vote), said, (F.col("groups") <= GROUPS_OF_ONE_VALUE).cast("int"), writing]
    return judged(names, votes, NAME_SOURCES)


def mbid_values(values: DataFrame) -> DataFrame:
    """The mbid values of each group with their posterior.

    Five sources: the form (letters, digits and dashes in their places) that is usual among all tracks or all albums, the usual length, the other groups,
    and the variety of digits. What is usual is counted from all claims, not written down.
    """
    form = F.regexp_replace(F.regexp_replace("value", "[0-9a-f]", "h"), "[^h-]", "x")
    digits = F.size(F.array_distinct(F.split(F.replace("value", F.lit("-"), F.lit("")), "")))
    mbids = values.filter("field = 'mbid'").withColumns({"form": form, "length": F.length("value"), "digits": digits})
    # The form under which the most different values are written; of equals the one with more claims, then the longer one.
    different = mbids.groupBy("origin", "form", "length", "value").agg(F.count("*").alias("n")).groupBy("origin", "form", "length").agg(F.count("*").alias("values"), F.sum("n").alias("n"))
    usual = lambda c: F.max_by(c, F.struct("values", "n", "length", "form"))
    forms = different.groupBy("origin").agg(usual("form").alias("usual_form"), usual("length").alias("usual_length"))
    mbids = mbids.join(F.broadcast(forms), "origin")  # a row for each table
    formed = (F.col("form") == F.col("usual_form")).cast("int")
    votes = [_by_origin("tracks", formed), _by_origin("albums", formed), (F.col("length") == F.col("usual_length")).cast("int"), (F.col("groups") <= GROUPS_OF_ONE_VALUE).cast("int"), (F.col("digits") > 2).cast("int")]
    return judged(mbids, votes, MBID_SOURCES)


def value_sets(claims: DataFrame, least: float = 0.5) -> DataFrame:
    """(dup_group, field, value, vkey, records, posterior, is_true): the set of values of each field that a group claims, all that are judged true kept.

    An mbid must also have the form of one and be other than zero, the exact check. Blank values claim nothing and are no rows; empty tables give none.
    """
    values = field_values(claims)
    field = lambda df, ok: df.select("dup_group", "field", "value", "vkey", "records", "posterior", ok.alias("is_true"))
    shaped = F.col("value").rlike(MBID) & F.col("value").rlike("[1-9a-f]")
    return field(name_values(claims, values), F.col("posterior") > least).unionByName(field(mbid_values(values), (F.col("posterior") > least) & shaped))


def true_values(claims: DataFrame, least: float = 0.5) -> DataFrame:
    """claims with name_posterior and mbid_posterior and the flags name_true and mbid_true of the value that each row claims.

    A blank value has the posterior 0. A value or group with a third of all rows is joined back by broadcast (see join_by_size).
    """
    sets = value_sets(claims, least)

    def with_field(df: DataFrame, field: str, column: str) -> DataFrame:
        keyed = df.withColumn("vkey", F.xxhash64(F.lit(field), "dup_group", folded(F.col(column))))
        claimed, blank = keyed.filter(folded(F.col(column)).isNotNull()), keyed.filter(folded(F.col(column)).isNull())
        of = sets.filter(F.col("field") == field).select("vkey", F.col("posterior").alias(f"{field}_posterior"), F.col("is_true").alias(f"{field}_true"), F.col("records").alias("_size"))
        found = join_by_size(claimed, of, "vkey", "_size")
        return found.unionByName(blank.withColumns({f"{field}_posterior": F.lit(0.0), f"{field}_true": F.lit(False)})).drop("vkey")

    return with_field(with_field(claims, "name", "name"), "mbid", "mbid")


def survivors(claims: DataFrame) -> DataFrame:
    """One row per dup_group: the ids whose name and mbid survive ('' if none) and these values (NULL if none).

    Of the values judged true the one with the latest time, then the larger count, then the smaller id; NULL times and counts come last.
    min_by is reduced in each task first, so a group with a third of all rows moves as one row per task. mbids with outer blanks lack the exact form and don't survive.
    """
    order = F.struct(F.col("latest").isNull(), -F.unix_micros("latest"), F.col("plays").isNull(), -F.col("plays"), F.col("id"))
    first = lambda c, flag: F.min_by(F.when(F.col(flag), F.col(c)), F.when(F.col(flag), order))
    exact = true_values(claims).withColumn("mbid_true", F.col("mbid_true") & F.col("mbid").rlike(MBID))
    return exact.groupBy("dup_group").agg(
        F.coalesce(first("id", "name_true"), F.lit("")).alias("name_from"), F.coalesce(first("id", "mbid_true"), F.lit("")).alias("mbid_from"), first("name", "name_true").alias("name"), first("mbid", "mbid_true").alias("mbid")
    )
