"""Two-system record linkage by rules: normal forms, exact and fuzzy candidates, resolution, clusters, ledger, duplicates, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.dates import whole_minutes_apart
from tidemill.functions.maths import f1, ratio, weighted_mean
from tidemill.functions.text import email_key, name_key, phone_key, phone_key_loose, similarity_ratio, zip_key, zip_key_loose
from tidemill.operators.components import connected_components, number_in_order

#: Minutes within which records of one enquiry may lie.
DAY_MINUTES = 1440
# Rules with their scores, strongest first.
RULES = [("email_phone_time", ["email_norm", "phone_norm"], 1.00), ("email_time", ["email_norm"], 0.95), ("phone_time", ["phone_norm"], 0.95), ("name_zip_time", ["name_norm", "zip_norm"], 0.85)]
# Weights of the evidence, share of identity in the score, decay of time in minutes, thresholds.
WEIGHTS = {"email": 0.35, "phone": 0.30, "name": 0.20, "zip": 0.15}
IDENTITY_SHARE, DECAY_MINUTES, AUTO, REVIEW, LEAST_EVIDENCE = 0.85, 180.0, 0.90, 0.75, 2


def normalized(df: DataFrame) -> DataFrame:
    """df with name_norm, email_norm, phone_norm and zip_norm."""
    return df.withColumns({"name_norm": name_key(F.col("name")), "email_norm": email_key(F.col("email")), "phone_norm": phone_key(F.col("phone")), "zip_norm": zip_key(F.col("zip_code"))})


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, minutes: int) -> DataFrame:
    """Inner join on keys with times at most `minutes` whole minutes apart; NULL keys match nothing.

    Time is cut into spans of that width and each right row asks three of them, so a key with a third of all rows is spread over
    as many groups as there are spans.
    """
    width = (minutes + 1) * 60_000_000
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(width))
    asked = right.withColumn("_span", F.explode(F.array(span(right_at) - 1, span(right_at), span(right_at) + 1)))
    met = left.withColumn("_span", span(left_at)).join(asked, [*keys, "_span"]).drop("_span")
    return met.withColumn("time_delta_minutes", whole_minutes_apart(F.col(left_at), F.col(right_at))).filter(F.col("time_delta_minutes") <= minutes)


def exact_candidates(crm: DataFrame, marketing: DataFrame) -> DataFrame:
    """Pairs that agree by any rule within a day; of several rules the strongest stays."""
    found = None
    for rank, (rule, keys, score) in enumerate(RULES):
        pairs = band_join(crm.select("crm_record_id", "created_at", *keys), marketing.select("marketing_record_id", "captured_at", *keys), keys, "created_at", "captured_at", DAY_MINUTES)
        part = pairs.select("crm_record_id", "marketing_record_id", "time_delta_minutes", F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("match_rule"), F.lit(score).alias("match_score")).alias("r"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("crm_record_id", "marketing_record_id").agg(F.min("time_delta_minutes").alias("time_delta_minutes"), F.min("r").alias("r"))
    return best.select("crm_record_id", "marketing_record_id", "time_delta_minutes", "r.match_rule", "r.match_score")


def fuzzy_candidates(crm: DataFrame, marketing: DataFrame, exact: DataFrame) -> DataFrame:
    """Pairs of the same service within a day that no exact rule has found."""
    fields = ["name", "email", "phone", "zip_code"]
    left = crm.select("crm_record_id", "created_at", "service", *[F.col(f).alias(f"crm_{f}") for f in fields])
    right = marketing.select("marketing_record_id", "captured_at", "service", *[F.col(f).alias(f"marketing_{f}") for f in fields])
    return band_join(left, right, ["service"], "created_at", "captured_at", DAY_MINUTES).join(exact.select("crm_record_id", "marketing_record_id"), ["crm_record_id", "marketing_record_id"], "left_anti")


#: Normal forms of the fields that scores compare; each leaves its own results as they are.
LOOSE = {"name": lambda c: F.nullif(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit("")), "email": email_key, "phone": phone_key_loose, "zip": zip_key_loose}


def _field(f: str, side: str = "") -> Column:
    return F.col(f"{side}{'zip_code' if f == 'zip' else f}")


def loose(df: DataFrame) -> DataFrame:
    """df with its four fields in the normal forms that scored compares, so that they are made once a record and not once a pair."""
    return df.withColumns({"zip_code" if f == "zip" else f: norm(_field(f)) for f, norm in LOOSE.items()})


def plausible(candidates: DataFrame, least: float = REVIEW) -> DataFrame:
    """Candidates of loose records whose score can reach `least`: resolved loses none, and the costly similarity is left for few.

    Of texts with lengths m and n the insert-delete distance is no less than Levenshtein's, so no similarity is above
    1 - levenshtein / (m + n); nearness in time counts as it is.
    """
    ends = {f: (_field(f, "crm_"), _field(f, "marketing_")) for f in WEIGHTS}
    most = [(F.lit(1.0) - F.levenshtein(a, b) / (F.length(a) + F.length(b)), F.lit(WEIGHTS[f])) for f, (a, b) in ends.items()]
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in most), F.lit(0.0))
    reached = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in most), F.lit(0.0))
    known = sum((s.isNotNull().cast("int") for s, _ in most), F.lit(0))
    time = F.exp(-F.col("time_delta_minutes") / F.lit(DECAY_MINUTES))
    # As a product, for the weight may be 0; the slack is for rounding.
    return candidates.filter((known >= LEAST_EVIDENCE) & (F.lit(IDENTITY_SHARE) * reached >= (F.lit(least - 1e-9) - F.lit(1 - IDENTITY_SHARE) * time) * weight))


def scored(candidates: DataFrame, loosened: bool = False) -> DataFrame:
    """Similarities, identity, time and final score of candidates (G05, F17, M04, M05, X03); loosened: they are of loose records, so their fields are compared as they are."""
    form = lambda f, side: _field(f, side) if loosened else LOOSE[f](_field(f, side))
    compared = candidates.withColumns({f"{f}_similarity": similarity_ratio(form(f, "crm_"), form(f, "marketing_")) for f in LOOSE})
    parts = [(F.col(f"{f}_similarity"), w) for f, w in WEIGHTS.items()]
    known = compared.withColumns(
        {
            "identity_score": weighted_mean(parts),
            "time_score": F.exp(-F.col("time_delta_minutes") / F.lit(DECAY_MINUTES)),
            "evidence_count": sum((c.isNotNull().cast("long") for c, _ in parts), F.lit(0).cast("long")),
            "evidence_weight": sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0)),
        }
    )
    score = F.lit(IDENTITY_SHARE) * F.col("identity_score") + F.lit(1 - IDENTITY_SHARE) * F.col("time_score")
    return known.withColumn("fuzzy_score", F.coalesce(score, F.lit(0.0)))


def resolved(exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Exact pairs as they are; scored ones above the thresholds, for review below the upper."""
    sure = exact.select("crm_record_id", "marketing_record_id", "time_delta_minutes", "match_rule", "match_score", F.lit("exact").alias("match_method"), F.lit("auto_match").alias("review_status"))
    kept = fuzzy.filter((F.col("fuzzy_score") >= REVIEW) & (F.col("evidence_count") >= LEAST_EVIDENCE))
    rest = kept.select("crm_record_id", "marketing_record_id", "time_delta_minutes", F.lit("fuzzy_identity").alias("match_rule"), F.col("fuzzy_score").alias("match_score"), F.lit("fuzzy").alias("match_method"), F.when(F.col("fuzzy_score") >= AUTO, "auto_match").otherwise("manual_review").alias("review_status"))
    return sure.unionByName(rest)


def review_queue(links: DataFrame) -> DataFrame:
    """Links that wait for a look."""
    return links.filter(F.col("review_status") == "manual_review")


def cluster_members(links: DataFrame) -> DataFrame:
    """(reconciled_lead_id, system, record_id, component) of accepted links; ids count up in order of the smallest node."""
    accepted = links.filter(F.col("review_status") == "auto_match").select(F.concat(F.lit("crm:"), "crm_record_id").alias("a"), F.concat(F.lit("marketing:"), "marketing_record_id").alias("b"))
    nodes = connected_components(accepted, "a", "b")
    ids = number_in_order(nodes.select("component").distinct(), "component", "no").select("component", F.format_string("RCL%07d", "no").alias("reconciled_lead_id"))
    return nodes.join(ids, "component").select("reconciled_lead_id", F.split_part("node", F.lit(":"), F.lit(1)).alias("system"), F.expr("substring(node, instr(node, ':') + 1)").alias("record_id"))


def clusters(links: DataFrame, members: DataFrame) -> DataFrame:
    """Counts and flags of each cluster."""
    of = members.groupBy("reconciled_lead_id").agg(F.count_if(F.col("system") == "crm").alias("crm_record_count"), F.count_if(F.col("system") == "marketing").alias("marketing_record_count"))
    edges = links.filter(F.col("review_status") == "auto_match").join(members.filter("system = 'crm'").select("reconciled_lead_id", F.col("record_id").alias("crm_record_id")), "crm_record_id")
    kinds = edges.groupBy("reconciled_lead_id").agg(F.count("*").alias("match_edge_count"), F.count_if(F.col("match_method") == "exact").alias("exact_edge_count"), F.count_if(F.col("match_method") == "fuzzy").alias("fuzzy_edge_count"))
    c, m = F.col("crm_record_count") > 1, F.col("marketing_record_count") > 1
    return of.join(kinds, "reconciled_lead_id").withColumns({"has_crm_duplicates": c, "has_marketing_duplicates": m, "is_many_to_many": c & m})


def first_known(value: str, order: str) -> Column:
    """The first value that isn't NULL in ascending order of a key (A10)."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def ledger(crm: DataFrame, marketing: DataFrame, members: DataFrame) -> DataFrame:
    """One row per cluster and per record outside any: who is in it, when and whence.

    Where both systems know a time, campaign or service, marketing's stands. Fields come from the first record by id that knows them.
    """

    def side(df: DataFrame, system: str, key: str, at: str, source: str) -> DataFrame:
        rows = df.select(F.col(key).alias("record_id"), F.col(at).alias("at"), F.col(source).alias("source"), "campaign", "service")
        joined = rows.join(members.filter(F.col("system") == system).select("record_id", "reconciled_lead_id"), "record_id", "left")
        owner = F.coalesce("reconciled_lead_id", F.concat(F.lit(f"{system}:"), "record_id"))
        return joined.withColumn("ledger_id", owner).groupBy("ledger_id").agg(
            F.min("record_id").alias(f"{system}_first_id"), F.count("*").alias(f"{system}_records"), F.min("at").alias(f"{system}_at"), *[first_known(c, "record_id").alias(f"{system}_{c}") for c in ("source", "campaign", "service")]
        )

    both = side(crm, "crm", "crm_record_id", "created_at", "source").join(side(marketing, "marketing", "marketing_record_id", "captured_at", "source_label"), "ledger_id", "full")
    return both.select(
        "ledger_id", F.when(F.col("crm_records").isNull(), "marketing_only").when(F.col("marketing_records").isNull(), "crm_only").otherwise("both").alias("ledger_kind"),
        F.col("crm_first_id"), F.col("marketing_first_id"), F.coalesce("crm_records", F.lit(0)).alias("crm_records"), F.coalesce("marketing_records", F.lit(0)).alias("marketing_records"),
        *[F.coalesce(f"marketing_{c}", f"crm_{c}").alias(n) for c, n in (("at", "event_at"), ("source", "source"), ("campaign", "campaign"), ("service", "service"))],
    )


def duplicate_pairs(records: DataFrame, record_id: str, at: str, minutes: int) -> DataFrame:
    """(a, b), a < b, of records of one system and service that agree by a rule within `minutes`."""
    found = None
    for _, keys, _ in RULES[1:]:
        use = [*keys, "service"]
        left = records.select(F.col(record_id).alias("a"), F.col(at).alias("ta"), *use)
        right = records.select(F.col(record_id).alias("b"), F.col(at).alias("tb"), *use)
        part = band_join(left, right, use, "ta", "tb", minutes).filter("a < b").select("a", "b")
        found = part if found is None else found.union(part)
    return found.distinct()


def duplicate_groups(records: DataFrame, record_id: str, at: str, minutes: int) -> DataFrame:
    """(record_id, group_id) of all records; a record without duplicates is its own group."""
    nodes = records.select(F.col(record_id).alias("node"))
    return connected_components(duplicate_pairs(records, record_id, at, minutes), "a", "b", nodes).select(F.col("node").alias(record_id), F.col("component").alias("group_id"))


def evaluate_pairs(pairs: DataFrame, crm_truth: DataFrame, marketing_truth: DataFrame) -> DataFrame:
    """One row of precision, recall and F1 over pairs, and of recall over true leads.

    crm_truth, marketing_truth: record_id, truth. A pair is right if both truths are known and equal. Ratios are NULL for empty denominators.
    """
    a, b = crm_truth.select(F.col("record_id").alias("crm_record_id"), F.col("truth").alias("ta")), marketing_truth.select(F.col("record_id").alias("marketing_record_id"), F.col("truth").alias("tb"))
    judged = pairs.join(a, "crm_record_id", "left").join(b, "marketing_record_id", "left").withColumn("right", F.coalesce(F.col("ta") == F.col("tb"), F.lit(False)))
    counts = lambda df, c: df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("truth")).agg(F.count("*").alias(f"n{c}"))
    # The number of possible pairs is a sum of products of counts: no pair is made.
    shared = counts(a, "ta").join(counts(b, "tb"), "truth").agg(F.coalesce(F.sum(F.col("nta") * F.col("ntb")), F.lit(0)).alias("pair_possible"), F.count("*").alias("lead_possible"))
    got = judged.agg(F.count("*").alias("pair_predicted"), F.count_if("right").alias("pair_true_positives"), F.count_distinct(F.when(F.col("right"), F.col("ta"))).alias("lead_recovered"))
    both = got.crossJoin(F.broadcast(shared)).withColumns({"pair_precision": ratio(F.col("pair_true_positives"), F.col("pair_predicted")), "pair_recall": ratio(F.col("pair_true_positives"), F.col("pair_possible")), "lead_recall": ratio(F.col("lead_recovered"), F.col("lead_possible"))})
    return both.withColumn("pair_f1", f1(F.col("pair_precision"), F.col("pair_recall")))


def group_purity(members: DataFrame, truth: DataFrame) -> DataFrame:
    """(group_id, truth): the one truth of a group's records, NULL where they have several or none."""
    joined = members.join(truth, "record_id", "left")
    return joined.groupBy("group_id").agg(F.count_distinct("truth").alias("n"), F.min("truth").alias("t")).select("group_id", F.when(F.col("n") == 1, F.col("t")).alias("truth"))


def quality_by(judged: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """(keys, pairs, right_pairs, precision_) of judged pairs by stage, method or whatever keys name."""
    return judged.groupBy(*keys).agg(F.count("*").alias("pairs"), F.count_if(F.col(ok)).alias("right_pairs")).withColumn("precision_", ratio(F.col("right_pairs"), F.col("pairs")))
