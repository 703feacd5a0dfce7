"""Queries of the problems of training data, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import canonical, components, languages, leaks, linkage, mixing, people, survivors
from tidemill.plans.registry import Registry
from tidemill.session import cut
from tidemill.sources.tables import Tables

R = Registry()

_GROUPS = r"""
WITH RECURSIVE pairs AS (
    SELECT 'crm:' || upper(regexp_replace(crm_record_id, '^\s+|\s+$', '', 'g')) AS a, 'marketing:' || upper(regexp_replace(marketing_record_id, '^\s+|\s+$', '', 'g')) AS b,
           coalesce(lower(regexp_replace(review_status, '^\s+|\s+$', '', 'g')) IN ('auto_match', 'confirmed'), false) AS ok
    FROM match_pairs),
members AS (
    SELECT lower(regexp_replace(system, '^\s+|\s+$', '', 'g')) || ':' || upper(regexp_replace(record_id, '^\s+|\s+$', '', 'g')) AS a,
           nullif(upper(regexp_replace(reconciled_lead_id, '^\s+|\s+$', '', 'g')), '') AS lead
    FROM membership),
edges AS (
    SELECT a, b FROM pairs WHERE ok UNION SELECT b, a FROM pairs WHERE ok
    UNION SELECT a, '~' || lead FROM members WHERE lead IS NOT NULL UNION SELECT '~' || lead, a FROM members WHERE lead IS NOT NULL),
nodes AS (SELECT a FROM edges UNION SELECT a FROM members UNION SELECT a FROM pairs UNION SELECT b FROM pairs),
reach AS (SELECT a AS node, a AS seen FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
groups AS (SELECT node, min(seen) AS group_key, count(*) FILTER (WHERE seen NOT LIKE '~%') AS n FROM reach WHERE node NOT LIKE '~%' AND node IS NOT NULL GROUP BY node)
SELECT split_part(node, ':', 1) AS system, substr(node, instr(node, ':') + 1) AS record_id, group_key FROM groups"""


@R.query("p2_found", _GROUPS + " WHERE n > 1")
def p2_found(t: Tables) -> DataFrame:
    """Records linked to at least one other, with the smallest record of their group."""
    grouped = components.record_groups(t.match_pairs, t.membership).withColumn("own", F.concat("system", F.lit(":"), "record_id"))
    others = grouped.filter(F.col("own") != F.col("group_key"))
    heads = others.select("group_key").distinct()
    split = heads.select(F.split_part("group_key", F.lit(":"), F.lit(1)).alias("system"), F.expr("substring(group_key, instr(group_key, ':') + 1)").alias("record_id"), "group_key")
    return others.drop("own").unionByName(split)


@R.query("p2_record_groups", _GROUPS)
def p2_record_groups(t: Tables) -> DataFrame:
    """Every record of the archive with its one group."""
    return components.record_groups(t.match_pairs, t.membership)


@R.query("p3_found")
def p3_found(t: Tables) -> DataFrame:
    """Freely typed lead sources and tags with the entry meant, '' where none is."""
    sources = canonical.map_rows(canonical.lead_source_rows(t.crm_leads, t.ref_lead_source), t.ref_lead_source, "canonical_source", canonical.SOURCE_WRAPPERS, True, canonical.SOURCE_SYNONYMS)
    tags = canonical.map_rows(canonical.unresolved_tag_rows(t.dim_tag_taxonomy), t.ref_genre, "canonical_genre", canonical.TAG_WRAPPERS, False)
    named = lambda df, field: df.select(F.lit(field).alias("field"), "row_key", "canonical_value")
    return named(sources, "source").unionByName(named(tags, "tag_norm"))


@R.query("p4_found")
def p4_found(t: Tables) -> DataFrame:
    """Each pair of records of the same person or firm, through the groups of variant spellings."""
    return people.entity_pairs(people.entities(t.crm_leads, "crm_record_id"), "crm_record_id")


@R.query("p4_entities")
def p4_entities(t: Tables) -> DataFrame:
    """Every record with its person or firm and its number of direct links."""
    return people.entities(t.crm_leads, "crm_record_id")


def _duplicates(t: Tables) -> DataFrame:
    tracks = survivors.claims_of(t.dim_track, "track_id", "track_name", "track_norm", "track_mbid")
    return tracks.unionByName(survivors.claims_of(t.dim_album, "album_id", "album_name", "album_norm", "album_mbid", "albums"))


_SURVIVORS = r"""
WITH rows AS (
    SELECT dup_group, track_id AS id, track_name AS name, track_norm AS keyed, track_mbid AS mbid, latest_scrobble_at AS t, scrobble_count AS n FROM dim_track
    UNION ALL SELECT dup_group, album_id, album_name, album_norm, album_mbid, latest_scrobble_at, scrobble_count FROM dim_album),
judged AS (
    SELECT *, trim(coalesce(name, '')) <> '' AND lower(trim(name)) = lower(trim(keyed)) AS name_ok,
           coalesce(regexp_full_match(mbid, '[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}') AND regexp_matches(mbid, '[1-9A-Fa-f]'), false) AS mbid_ok
    FROM rows WHERE dup_group IS NOT NULL),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY dup_group, name_ok ORDER BY t DESC NULLS LAST, n DESC NULLS LAST, id) AS name_rank,
           row_number() OVER (PARTITION BY dup_group, mbid_ok ORDER BY t DESC NULLS LAST, n DESC NULLS LAST, id) AS mbid_rank
    FROM judged)
SELECT dup_group, coalesce(max(id) FILTER (WHERE name_ok AND name_rank = 1), '') AS name_from, coalesce(max(id) FILTER (WHERE mbid_ok AND mbid_rank = 1), '') AS mbid_from
FROM placed GROUP BY dup_group"""


@R.query("p5_found", _SURVIVORS)
def p5_found(t: Tables) -> DataFrame:
    """From which row the surviving name and mbid of each group come."""
    return survivors.survivors(_duplicates(t)).select("dup_group", "name_from", "mbid_from")


@R.query("p5_true_values")
def p5_true_values(t: Tables) -> DataFrame:
    """Every name and mbid of a group with the probability that it is a true value of it."""
    return survivors.true_values(_duplicates(t)).select("dup_group", "id", "name", "mbid", "name_posterior", "mbid_posterior", "name_true", "mbid_true")


_VALUE_SETS = _SURVIVORS.split("placed AS")[0].rstrip().rstrip(",") + """
SELECT dup_group, 'name' AS field, lower(trim(name)) AS value, count(*) AS records, bool_or(name_ok) AS is_true FROM judged WHERE trim(coalesce(name, '')) <> '' GROUP BY dup_group, lower(trim(name))
UNION ALL SELECT dup_group, 'mbid', lower(trim(mbid)), count(*), bool_or(mbid_ok) FROM judged WHERE trim(coalesce(mbid, '')) <> '' GROUP BY dup_group, lower(trim(mbid))"""


@R.query("p5_value_sets", _VALUE_SETS)
def p5_value_sets(t: Tables) -> DataFrame:
    """The set of values that each group claims of a field, with those that are judged true."""
    return survivors.value_sets(_duplicates(t)).select("dup_group", "field", "value", "records", "is_true")


@R.query("p6_found")
def p6_found(t: Tables) -> DataFrame:
    """Pairs of records that describe the same enquiry."""
    return linkage.match_records(t.crm_leads, t.marketing_leads).select("crm_record_id", "marketing_record_id")


@R.query("p6_matches")
def p6_matches(t: Tables) -> DataFrame:
    """Matches with their confidence."""
    return linkage.match_records(t.crm_leads, t.marketing_leads)


@R.query("p8_found")
def p8_found(t: Tables) -> DataFrame:
    """Documents that hold more than half of an item in one stretch."""
    return leaks.find_leaks(t.documents, "doc_id", "text", t.eval_items, "item_id", "text").select("doc_id", "item_id")


@R.query("p9_mixture")
def p9_mixture(t: Tables) -> DataFrame:
    """Documents of the mixture and how often each is taken."""
    return mixing.mixture(t.documents, "doc_id", "text", "source", t.mix_targets)


@R.query("p9_shares")
def p9_shares(t: Tables) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(mixing.mixture(t.documents, "doc_id", "text", "source", t.mix_targets), t.mix_targets)


@R.query("p9_bounds", "SELECT source, target_share, true AS share_is_met, true AS repeats_are_kept, true AS documents_are_of_source FROM mix_targets")
def p9_bounds(t: Tables) -> DataFrame:
    """What must hold of the mixture: shares within half a percent, no document more often than allowed, all of the source they are counted for."""
    mixed = cut(mixing.mixture(t.documents, "doc_id", "text", "source", t.mix_targets))
    owners = t.documents.select("doc_id", F.col("source").alias("owner"))
    strange = mixed.join(owners, "doc_id").groupBy("source").agg(F.count_if(F.col("owner") != F.col("source")).alias("strange"))
    found = mixing.shares(mixed, t.mix_targets).join(strange, "source", "left")
    met = F.abs(F.col("actual_share") - F.col("target_share")) < 0.005
    return found.select("source", "target_share", met.alias("share_is_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_are_kept"), (F.coalesce("strange", F.lit(0)) == 0).alias("documents_are_of_source"))


def _segments(t: Tables) -> DataFrame:
    # Genre tags count for no language. The whole list is sent with the network: it is a reference list, not data.
    tags = languages.Phrases([r["canonical_genre"] for r in t.ref_genre.select("canonical_genre").collect() if r["canonical_genre"]])
    net = languages.train(languages.labelled_sample(t.documents, "doc_id", "text", "lang"), tags)
    return languages.document_segments(t.documents, "doc_id", "text", net, tags)


@R.query("p10_found")
def p10_found(t: Tables) -> DataFrame:
    """Languages of documents that are labelled wrongly or not at all, or that mix languages."""
    return languages.wrong_labels(t.documents, _segments(t), "doc_id", "lang")


@R.query("p10_segments")
def p10_segments(t: Tables) -> DataFrame:
    """Every document's segments with language and confidence; a document of one language has one."""
    return _segments(t)
