"""Clusters, ledger and evaluation are fed by all accepted links, fuzzy ones included."""

import math
import random
from datetime import timedelta
from types import SimpleNamespace

from tests.conftest import rows
from tests.test_linkage import FIELDS, T0, lcs, union_find
from tidemill.operators import linkage as K
from tidemill.plans import matching

WEIGHTS = {"name": 0.20, "email": 0.35, "phone": 0.30, "zip_code": 0.15}


def tables(spark, crm, mkt):
    return SimpleNamespace(
        crm_leads=spark.createDataFrame([(*r, "src", "cmp") for r in crm], f"crm_record_id string, created_at timestamp_ntz, {FIELDS}, source string, campaign string"),
        marketing_leads=spark.createDataFrame([(*r, "src", "cmp") for r in mkt], f"marketing_record_id string, captured_at timestamp_ntz, {FIELDS}, source_label string, campaign string"),
    )


# C2 and M1 differ by a slip in both address and phone, and by one in the name: no exact rule holds.
CRM = [("C1", T0, "Ann Leeward", "ann.leeward@mail.com", "2125550101", "01234", "s"), ("C2", T0, "Ann Leewrd", "ann.leewrd@mail.com", "2125550107", "01234", "s"), ("C3", T0, "Zed Other", "zed@else.org", "9175550199", "99999", "s")]
MKT = [("M1", T0 + timedelta(minutes=1), "Ann Leeward", "ann.leeward@mail.com", "2125550101", "01234", "s")]


def test_fuzzy_links_reach_every_query(spark):
    t = tables(spark, CRM, MKT)
    assert rows(matching.cluster_members(t), "system", "record_id") == [("crm", "C1"), ("crm", "C2"), ("marketing", "M1")]
    assert rows(matching.clusters(t), "crm_record_count", "exact_edge_count", "fuzzy_edge_count", "has_crm_duplicates") == [(2, 1, 1, True)]
    assert rows(matching.ledger(t), "ledger_kind", "crm_records", "marketing_records") == [("both", 2, 1), ("crm_only", 1, 0)]
    assert rows(matching.pair_evaluation(t), "pair_predicted", "pair_true_positives") == [(2, 1)]
    assert rows(matching.group_purity(t)) == [("RCL0000001", None)]


def brute(crm, mkt):
    """(crm, marketing, method, status) by comparing all pairs; records here are in normal form but for NULLs."""
    out = []
    for c in crm:
        for m in mkt:
            gap = abs(c[1] - m[1]) // timedelta(minutes=1)
            if gap > 1440:
                continue
            same = {f: a is not None and a == b for f, a, b in zip(WEIGHTS, c[2:6], m[2:6])}
            if same["email"] or same["phone"] or (same["name"] and same["zip_code"]):
                out.append((c[0], m[0], "exact", "auto_match"))
            elif c[6] == m[6]:
                s = {f: 2 * lcs(a, b) / (len(a) + len(b)) for f, a, b in zip(WEIGHTS, c[2:6], m[2:6]) if a is not None and b is not None}
                if len(s) >= 2:
                    score = 0.85 * sum(WEIGHTS[f] * x for f, x in s.items()) / sum(WEIGHTS[f] for f in s) + 0.15 * math.exp(-gap / 180)
                    if score >= 0.75:
                        out.append((c[0], m[0], "fuzzy", "auto_match" if score >= 0.90 else "manual_review"))
    return sorted(out)


def test_links_and_clusters_equal_brute_force(spark):
    r = random.Random(7)
    people = [("".join(r.choice("abcdefgh") for _ in range(9)), "".join(r.choice("klmnop") for _ in range(8)) + "@mail.com", f"{2120000000 + r.randrange(10**7)}", f"{10000 + r.randrange(80000)}") for _ in range(14)]

    def slip(x):
        if r.random() < 0.08:
            return None
        k = r.randrange(len(x))
        return x if r.random() < 0.45 else x[:k] + r.choice("019" if x.isdigit() else "abkm") + x[k + 1 :]

    def record(no, at):
        return (no, at, *map(slip, people[int(no[1:]) % 14]), r.choice("st") if r.random() < 0.2 else "s")

    crm = [record(f"C{k:02}", T0 + timedelta(minutes=r.randrange(60))) for k in range(42)]
    mkt = [record(f"M{k:02}", T0 + timedelta(minutes=r.randrange(1600))) for k in range(42)]
    want = brute(crm, mkt)
    assert {x[2:] for x in want} == {("exact", "auto_match"), ("fuzzy", "auto_match"), ("fuzzy", "manual_review")}
    t = tables(spark, crm, mkt)
    assert rows(matching.links(t), "crm_record_id", "marketing_record_id", "match_method", "review_status") == sorted(want, key=str)
    # A component's id stands for its smallest node.
    components = union_find([(f"crm:{a}", f"marketing:{b}") for a, b, _, status in want if status == "auto_match"])
    order = {c: f"RCL{k:07}" for k, c in enumerate(sorted({c for _, c in components}), 1)}
    assert rows(matching.cluster_members(t)) == sorted((order[c], *node.split(":")) for node, c in components)


def test_plausible_keeps_scored_links(spark):
    none = spark.createDataFrame([], "crm_record_id string, marketing_record_id string")
    t = tables(spark, CRM, [*MKT, ("M2", T0 + timedelta(minutes=5), " ann  LEEWARD", " Ann.Leewar@mail.com", "+1 (212) 555-0101", "01234-99", "s"), ("M3", T0, None, None, None, None, "s")])
    plain = K.scored(K.fuzzy_candidates(t.crm_leads, t.marketing_leads, none)).filter("fuzzy_score >= 0.75 and evidence_count >= 2")
    pruned = K.scored(K.plausible(K.fuzzy_candidates(K.loose(t.crm_leads), K.loose(t.marketing_leads), none))).filter("fuzzy_score >= 0.75")
    kept = ("crm_record_id", "marketing_record_id", "fuzzy_score")
    assert len(rows(plain, *kept)) == 4 and rows(pruned, *kept) == rows(plain, *kept)
