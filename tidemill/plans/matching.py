"""Queries of two-system linkage over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.maths import rounded
from tidemill.functions.text import email_key
from tidemill.operators import linkage as K
from tidemill.plans.registry import Registry
from tidemill.session import cut
from tidemill.sources.tables import Tables

R = Registry()

_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
_NORM = lambda table: f"""SELECT *, nullif(lower(trim(email)), '') AS email_norm, nullif(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]', '', 'g'), '') AS name_norm,
    CASE WHEN length({_DIGITS}) = 10 THEN {_DIGITS} WHEN length({_DIGITS}) = 11 AND {_DIGITS} LIKE '1%' THEN substr({_DIGITS}, 2) END AS phone_norm,
    CASE WHEN length(regexp_replace(zip_code, '[^0-9]', '', 'g')) >= 5 THEN substr(regexp_replace(zip_code, '[^0-9]', '', 'g'), 1, 5) END AS zip_norm FROM {table}"""  # noqa: E731
_BOTH = f"WITH RECURSIVE crm AS ({_NORM('crm_leads')}), mkt AS ({_NORM('marketing_leads')})"
_GAP = "CAST(abs(epoch_us(created_at) - epoch_us(captured_at)) // 60000000 AS BIGINT)"
_RULE = lambda rank, name, score, on: f"SELECT crm_record_id, marketing_record_id, {_GAP} AS gap, {rank} AS rank, '{name}' AS match_rule, {score}::DOUBLE AS match_score FROM crm JOIN mkt ON {on} WHERE {_GAP} <= 1440"
_EXACT = _BOTH + ", ruled AS (" + " UNION ALL ".join(_RULE(k, name, score, " AND ".join(f"crm.{c} = mkt.{c}" for c in keys)) for k, (name, keys, score) in enumerate(K.RULES)) + """),
exact AS (SELECT crm_record_id, marketing_record_id, min(gap) AS time_delta_minutes, arg_min(match_rule, rank) AS match_rule, arg_min(match_score, rank) AS match_score FROM ruled GROUP BY ALL)"""  # fmt: skip


def crm(t: Tables) -> DataFrame:
    """Normalized CRM leads."""
    return K.normalized(t.crm_leads)


def marketing(t: Tables) -> DataFrame:
    """Normalized marketing leads."""
    return K.normalized(t.marketing_leads)


def exact(t: Tables) -> DataFrame:
    """Exact candidates."""
    return K.exact_candidates(crm(t), marketing(t))


def links(t: Tables) -> DataFrame:
    """Resolved links."""
    found = exact(t)
    # The cut keeps Spark from merging the two filters, which would score every candidate.
    return K.resolved(found, K.scored(cut(K.plausible(K.fuzzy_candidates(K.loose(t.crm_leads), K.loose(t.marketing_leads), found))), loosened=True))


_KEYS = "name_norm, email_norm, phone_norm, zip_norm"


@R.query("crm_normalized", f"{_BOTH} SELECT crm_record_id, {_KEYS} FROM crm")
def crm_normalized(t: Tables) -> DataFrame:
    """F07-F11."""
    return crm(t).select("crm_record_id", "name_norm", "email_norm", "phone_norm", "zip_norm")


@R.query("marketing_normalized", f"{_BOTH} SELECT marketing_record_id, {_KEYS} FROM mkt")
def marketing_normalized(t: Tables) -> DataFrame:
    """F07-F11."""
    return marketing(t).select("marketing_record_id", "name_norm", "email_norm", "phone_norm", "zip_norm")


@R.query("exact_candidates", f"{_EXACT} SELECT * FROM exact")
def exact_candidates(t: Tables) -> DataFrame:
    """G03."""
    return exact(t)


@R.query("fuzzy_candidates", f"{_EXACT} SELECT crm_record_id, marketing_record_id, {_GAP} AS time_delta_minutes FROM crm JOIN mkt ON crm.service = mkt.service WHERE {_GAP} <= 1440 AND (crm_record_id, marketing_record_id) NOT IN (SELECT (crm_record_id, marketing_record_id) FROM exact)")
def fuzzy_candidates(t: Tables) -> DataFrame:
    """G04."""
    return K.fuzzy_candidates(t.crm_leads, t.marketing_leads, exact(t)).select("crm_record_id", "marketing_record_id", "time_delta_minutes")


# The longest common subsequence in SQL, row by row of its table: the first list is the row before the first letter, the others are the letters.
_LCS = lambda a, b: f"""list_reduce(list_concat([list_transform(range(0, length({b}) + 1), lambda x: 0::BIGINT)], list_transform(string_split({a}, ''), lambda c: [unicode(c)::BIGINT])),
    lambda row, c: list_concat([0::BIGINT], list_transform(range(1, len(row)), lambda k: list_max(list_transform(range(1, k + 1), lambda q: CASE WHEN unicode(substr({b}, q, 1)) = c[1] THEN row[q] + 1 ELSE row[q + 1] END)))))[-1]"""  # noqa: E731
_SIM = lambda f: f"CASE WHEN a.{f} IS NULL OR b.{f} IS NULL THEN NULL WHEN a.{f} = b.{f} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {_LCS('a.' + f, 'b.' + f)} / (length(a.{f}) + length(b.{f})) END"
_FIELDS = ["name", "email", "phone", "zip"]
_LOOSE = lambda table, key, at: f"""SELECT {key}, service, {at}, nullif(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), '') AS name, nullif(lower(trim(email)), '') AS email,
    CASE WHEN length({_DIGITS}) = 11 AND {_DIGITS} LIKE '1%' THEN substr({_DIGITS}, 2) ELSE nullif({_DIGITS}, '') END AS phone, nullif(substr(regexp_replace(zip_code, '[^0-9]', '', 'g'), 1, 5), '') AS zip FROM {table}"""  # noqa: E731
_SUM = lambda what: " + ".join(f"coalesce({what(f)}, 0)" for f in _FIELDS)
_SCORED = f"""{_EXACT}, loose_crm AS ({_LOOSE('crm_leads', 'crm_record_id', 'created_at')}), loose_mkt AS ({_LOOSE('marketing_leads', 'marketing_record_id', 'captured_at')}),
sims AS MATERIALIZED (SELECT a.crm_record_id, b.marketing_record_id, {_GAP} AS gap, {', '.join(f'{_SIM(f)} AS {f}_similarity' for f in _FIELDS)}
    FROM loose_crm a JOIN loose_mkt b ON a.service = b.service WHERE {_GAP} <= 1440 AND (a.crm_record_id, b.marketing_record_id) NOT IN (SELECT (crm_record_id, marketing_record_id) FROM exact)),
weighed AS (SELECT *, {_SUM(lambda f: f"CASE WHEN {f}_similarity IS NOT NULL THEN 1 END")} AS evidence_count, exp(-gap / {K.DECAY_MINUTES}) AS time_score,
    ({_SUM(lambda f: f"{f}_similarity * {K.WEIGHTS[f]}")}) / nullif({_SUM(lambda f: f"CASE WHEN {f}_similarity IS NOT NULL THEN {K.WEIGHTS[f]} END")}, 0) AS identity_score FROM sims),
scored AS (SELECT *, coalesce({K.IDENTITY_SHARE} * identity_score + {1 - K.IDENTITY_SHARE} * time_score, 0) AS fuzzy_score FROM weighed),
resolved AS (SELECT crm_record_id, marketing_record_id, time_delta_minutes, match_rule, match_score, 'exact' AS match_method, 'auto_match' AS review_status FROM exact
    UNION ALL SELECT crm_record_id, marketing_record_id, gap, 'fuzzy_identity', fuzzy_score, 'fuzzy', CASE WHEN fuzzy_score >= {K.AUTO} THEN 'auto_match' ELSE 'manual_review' END FROM scored WHERE fuzzy_score >= {K.REVIEW} AND evidence_count >= {K.LEAST_EVIDENCE})"""
_ROUND = lambda c: f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}"
_SCORES = ["name_similarity", "email_similarity", "phone_similarity", "zip_similarity", "identity_score", "time_score", "fuzzy_score"]


@R.query("fuzzy_scored", f"{_SCORED} SELECT crm_record_id, marketing_record_id, CAST(evidence_count AS BIGINT) AS evidence_count, {', '.join(map(_ROUND, _SCORES))} FROM scored")
def fuzzy_scored(t: Tables) -> DataFrame:
    """G05."""
    return K.scored(K.fuzzy_candidates(K.loose(t.crm_leads), K.loose(t.marketing_leads), exact(t)), loosened=True).select("crm_record_id", "marketing_record_id", "evidence_count", *[rounded(F.col(c)).alias(c) for c in _SCORES])


@R.query("resolved_matches", f"{_SCORED} SELECT * REPLACE ({_ROUND('match_score')}) FROM resolved")
def resolved_matches(t: Tables) -> DataFrame:
    """G06."""
    return links(t).withColumn("match_score", rounded(F.col("match_score")))


@R.query("review_queue", f"{_SCORED} SELECT * REPLACE ({_ROUND('match_score')}) FROM resolved WHERE review_status = 'manual_review'")
def review_queue(t: Tables) -> DataFrame:
    """G07."""
    return K.review_queue(links(t)).withColumn("match_score", rounded(F.col("match_score")))


def accepted(t: Tables) -> DataFrame:
    """Links that need no look, exact and fuzzy, cut as they are read several times."""
    return cut(links(t).filter(F.col("review_status") == "auto_match"))


_CLUSTERS = f"""{_SCORED}, accepted AS MATERIALIZED (SELECT * FROM resolved WHERE review_status = 'auto_match'), links AS (SELECT 'crm:' || crm_record_id AS a, 'marketing:' || marketing_record_id AS b FROM accepted),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
labels AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
members AS (SELECT printf('RCL%07d', dense_rank() OVER (ORDER BY component)) AS reconciled_lead_id, split_part(node, ':', 1) AS system, substr(node, instr(node, ':') + 1) AS record_id FROM labels)"""


@R.query("cluster_members", f"{_CLUSTERS} SELECT * FROM members")
def cluster_members(t: Tables) -> DataFrame:
    """G01."""
    return K.cluster_members(accepted(t))


@R.query("clusters", f"""{_CLUSTERS}, counted AS (SELECT reconciled_lead_id, count(*) FILTER (system = 'crm') AS crm_record_count, count(*) FILTER (system = 'marketing') AS marketing_record_count FROM members GROUP BY 1),
linked AS (SELECT reconciled_lead_id, count(*) AS match_edge_count, count(*) FILTER (match_method = 'exact') AS exact_edge_count, count(*) FILTER (match_method = 'fuzzy') AS fuzzy_edge_count FROM accepted JOIN members ON record_id = crm_record_id AND system = 'crm' GROUP BY 1)
SELECT *, crm_record_count > 1 AS has_crm_duplicates, marketing_record_count > 1 AS has_marketing_duplicates, crm_record_count > 1 AND marketing_record_count > 1 AS is_many_to_many FROM counted JOIN linked USING (reconciled_lead_id)""")  # fmt: skip
def clusters(t: Tables) -> DataFrame:
    """G01."""
    found = accepted(t)
    return K.clusters(found, K.cluster_members(found))


_SIDE = lambda table, system, key, at, source: f"""{system}_side AS (SELECT coalesce(reconciled_lead_id, '{system}:' || {key}) AS ledger_id, min({key}) AS {system}_first_id, count(*) AS {system}_records, min({at}) AS {system}_at, arg_min({source}, {key}) FILTER ({source} IS NOT NULL) AS {system}_source,
    arg_min(campaign, {key}) FILTER (campaign IS NOT NULL) AS {system}_campaign, arg_min(service, {key}) FILTER (service IS NOT NULL) AS {system}_service FROM {table} LEFT JOIN members ON record_id = {key} AND system = '{system}' GROUP BY 1)"""  # noqa: E731


@R.query("ledger", f"""{_CLUSTERS}, {_SIDE('crm_leads', 'crm', 'crm_record_id', 'created_at', 'source')}, {_SIDE('marketing_leads', 'marketing', 'marketing_record_id', 'captured_at', 'source_label')}
SELECT ledger_id, CASE WHEN crm_records IS NULL THEN 'marketing_only' WHEN marketing_records IS NULL THEN 'crm_only' ELSE 'both' END AS ledger_kind, crm_first_id, marketing_first_id, coalesce(crm_records, 0) AS crm_records, coalesce(marketing_records, 0) AS marketing_records,
    epoch_us(coalesce(marketing_at, crm_at)) AS event_at, coalesce(marketing_source, crm_source) AS source, coalesce(marketing_campaign, crm_campaign) AS campaign, coalesce(marketing_service, crm_service) AS service FROM crm_side FULL JOIN marketing_side USING (ledger_id)""")  # fmt: skip
def ledger(t: Tables) -> DataFrame:
    """G08."""
    return K.ledger(t.crm_leads, t.marketing_leads, K.cluster_members(accepted(t))).withColumn("event_at", F.unix_micros(F.col("event_at").cast("timestamp")))


_DUPES = f"""{_BOTH}, pairs AS (SELECT DISTINCT a.marketing_record_id AS a, b.marketing_record_id AS b FROM mkt a JOIN mkt b ON a.service = b.service AND a.marketing_record_id < b.marketing_record_id
    AND (a.email_norm = b.email_norm OR a.phone_norm = b.phone_norm OR (a.name_norm = b.name_norm AND a.zip_norm = b.zip_norm)) AND abs(epoch_us(a.captured_at) - epoch_us(b.captured_at)) // 60000000 <= 15)"""


@R.query("duplicate_pairs", f"{_DUPES} SELECT * FROM pairs")
def duplicate_pairs(t: Tables) -> DataFrame:
    """J05."""
    return K.duplicate_pairs(marketing(t), "marketing_record_id", "captured_at", 15)


@R.query("duplicate_groups", f"""{_DUPES}, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT marketing_record_id, marketing_record_id FROM mkt),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a) SELECT node AS marketing_record_id, min(seen) AS group_id FROM reach GROUP BY node""")  # fmt: skip
def duplicate_groups(t: Tables) -> DataFrame:
    """G02, G10."""
    return K.duplicate_groups(marketing(t), "marketing_record_id", "captured_at", 15)


_TRUTH = "ct AS (SELECT crm_record_id, nullif(lower(trim(email)), '') AS ta FROM crm_leads), mt AS (SELECT marketing_record_id, nullif(lower(trim(email)), '') AS tb FROM marketing_leads)"


@R.query("pair_evaluation", f"""{_SCORED}, {_TRUTH}, judged AS (SELECT coalesce(ta = tb, false) AS ok, ta FROM (SELECT * FROM resolved WHERE review_status = 'auto_match') LEFT JOIN ct USING (crm_record_id) LEFT JOIN mt USING (marketing_record_id)),
got AS (SELECT count(*) AS pair_predicted, count(*) FILTER (ok) AS pair_true_positives, count(DISTINCT CASE WHEN ok THEN ta END) AS lead_recovered FROM judged),
shared AS (SELECT count(*) AS pair_possible, count(DISTINCT ta) AS lead_possible FROM ct JOIN mt ON ta = tb),
r AS (SELECT *, pair_true_positives / pair_predicted AS p, pair_true_positives / pair_possible AS q, lead_recovered / lead_possible AS l FROM got, shared)
SELECT pair_predicted, pair_true_positives, lead_recovered, pair_possible, lead_possible, floor(p * 1e6 + 0.5) / 1e6 AS pair_precision, floor(q * 1e6 + 0.5) / 1e6 AS pair_recall, floor(l * 1e6 + 0.5) / 1e6 AS lead_recall, floor(2 * p * q / (p + q) * 1e6 + 0.5) / 1e6 AS pair_f1 FROM r""")  # fmt: skip
def pair_evaluation(t: Tables) -> DataFrame:
    """G15, with the address as the truth that both tables know."""
    truth = lambda df, key: df.select(F.col(key).alias("record_id"), email_key(F.col("email")).alias("truth"))
    scored = K.evaluate_pairs(accepted(t), truth(t.crm_leads, "crm_record_id"), truth(t.marketing_leads, "marketing_record_id"))
    return scored.withColumns({c: rounded(F.col(c)) for c in ("pair_precision", "pair_recall", "lead_recall", "pair_f1")})


@R.query("group_purity", f"""{_CLUSTERS}, truth AS (SELECT crm_record_id AS record_id, nullif(lower(trim(email)), '') AS truth FROM crm_leads UNION ALL SELECT marketing_record_id, nullif(lower(trim(email)), '') FROM marketing_leads)
SELECT reconciled_lead_id AS group_id, CASE WHEN count(DISTINCT truth) = 1 THEN min(truth) END AS truth FROM members LEFT JOIN truth USING (record_id) GROUP BY 1""")
def group_purity(t: Tables) -> DataFrame:
    """A14, G16."""
    truth = lambda df, key: df.select(F.col(key).alias("record_id"), email_key(F.col("email")).alias("truth"))
    both = truth(t.crm_leads, "crm_record_id").unionByName(truth(t.marketing_leads, "marketing_record_id"))
    return K.group_purity(K.cluster_members(accepted(t)).withColumnRenamed("reconciled_lead_id", "group_id"), both)
