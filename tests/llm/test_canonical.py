"""Mapping of typed values against brute force over all forms."""

from tests.conftest import rows
from tidemill.llm import canonical as C


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
    return row[-1]


def slips(a, b):
    rest = list(b)
    for ch in a:
        if ch in rest:
            rest.remove(ch)
    return max(max(len(a), len(b)) - (len(b) - len(rest)), -(-levenshtein(a, b) // 2))


SOURCES = ["Search Advertising", "Organic Web", "Past Client Referral", "Phone Call", "Home Expo Booth", "Yard Sign"]
TYPED = [
    ("serach advertising", "Search Advertising"), ("SEARCH ADV", "Search Advertising"), ("advertising (search)", "Search Advertising"), ("srch advertising", "Search Advertising"), ("found organically on the web", "Organic Web"),
    ("organic website", "Organic Web"), ("PC referral", "Past Client Referral"), ("past client", "Past Client Referral"), ("ref. past client 2", "Past Client Referral"), ("pohne call", "Phone Call"), ("telephone call", "Phone Call"),
    ("h. expo booth", "Home Expo Booth"), ("expo", "Home Expo Booth"), ("yard_sign (see notes)", "Yard Sign"), ("walk past", ""), ("truck", ""), ("?", ""), ("see notes", ""), ("   ", ""), ("x" * 5000, ""), ("église", ""),
]


def mapped(spark, values, entries=SOURCES, subsets=True):
    reference = spark.createDataFrame([(k, e) for k, e in enumerate(entries)], "score int, entry string")
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return {r["value"]: (r["canonical_value"], r["score"]) for r in C.map_values(df, reference, "entry", C.SOURCE_WRAPPERS, subsets, C.SOURCE_SYNONYMS).collect()}


def test_typed_values(spark):
    got = mapped(spark, [v for v, _ in TYPED] + [None, "truck"])
    assert {v: got[v][0] for v, _ in TYPED} == dict(TYPED)
    assert None not in got


def test_equals_brute_force(spark):
    values = [v for v, _ in TYPED[:-3]] + ["searhc advertisinf", "hme xpo boot", "phon cal", "sign yrad", "organc wb"]
    reference = spark.createDataFrame([(e,) for e in SOURCES], "entry string")
    forms = C.reference_forms(reference, "entry", True).collect()
    typed = C.value_forms(spark.createDataFrame([(v,) for v in values], "value string"), C.SOURCE_WRAPPERS, C.SOURCE_SYNONYMS).collect()
    allowed = lambda n: 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 10 else 3 if n <= 13 else 4
    best = {v: (None, "") for v in values}
    for t in typed:
        for f in forms:
            if levenshtein(t["typed"], f["form"]) <= f["k"] and slips(t["typed"], f["form"]) <= allowed(len(f["form"])):
                score = (round(slips(t["typed"], f["form"]) + f["cost"] + t["vcost"], 6), f["canonical"])
                best[t["value"]] = min(best[t["value"]], score) if best[t["value"]][0] is not None else score
    got = mapped(spark, values)
    assert {v: got[v][0] for v in values} == {v: b[1] for v, b in best.items()}


def test_rows_repeats_and_empty_tables(spark):
    reference = spark.createDataFrame([(e,) for e in SOURCES], "entry string")
    data = spark.createDataFrame([("a", "expo", 1), ("b", "expo", 2), ("c", None, 3), ("d", "truck", 4)], "row_key string, value string, n int")
    got = rows(C.map_rows(data.drop("n"), reference, "entry", [], True), "row_key", "canonical_value")
    assert got == [("a", "Home Expo Booth"), ("b", "Home Expo Booth"), ("d", "")]
    assert rows(C.map_rows(data.drop("n").limit(0), reference, "entry", [], True)) == []
    assert rows(C.map_rows(data.drop("n"), reference.limit(0), "entry", [], True), "row_key", "canonical_value") == [("a", ""), ("b", ""), ("d", "")]


def test_short_and_long_entries(spark):
    """An entry of two letters is met by itself only; one of many words by most of them."""
    words = " ".join(f"w{chr(97 + k)}rd{chr(97 + k)}" for k in range(24))
    ref = spark.createDataFrame([("R&B",), (words,), ("X",), ("x" * 300,)], "g string")
    typed = ["r&b", "r b", "rx", "X", words.upper(), words.replace("wcrdc ", ""), "x" * 299, "of"]
    got = {r["value"]: r["canonical_value"] for r in C.map_values(spark.createDataFrame([(x,) for x in typed], "value string"), ref, "g", [], True).collect()}
    assert got == {"r&b": "R&B", "r b": "R&B", "rx": "", "X": "X", words.upper(): words, words.replace("wcrdc ", ""): words, "x" * 299: "x" * 300, "of": ""}
