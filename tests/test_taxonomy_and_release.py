"""Tags, release dates and generators."""

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemill.operators import release as D
from tidemill.operators import synthetic as Z
from tidemill.operators import taxonomy as X


def test_cascade_of_keys(spark):
    genres = spark.createDataFrame([(g,) for g in ("hip hop", "ab-c", "a-bc", "música lenta", "post-rock")], "genre string")
    aliases = spark.createDataFrame([("mpb", "post-rock"), ("odd", "no genre")], "tag_norm string, canonical_genre string")
    tags = spark.createDataFrame([(x,) for x in ("Hip  Hop", "Hip-Hop", "abc", "MPB", "odd", "musica lenta", "1999", "80s", "berlin", " ", None)], "tag string")
    resolved = X.resolve_tags(tags, genres, aliases)
    got = {r["tag_norm"]: (r["canonical_genre"], r["method"]) for r in resolved.collect()}
    assert got["hip hop"] == ("hip hop", "exact") and got["hip-hop"] == ("hip hop", "compact_alias") and got["abc"] == (None, "unresolved")
    assert got["mpb"] == ("post-rock", "manual_alias") and got["odd"] == (None, "unresolved") and got["musica lenta"] == ("música lenta", "accent_alias")
    curated = spark.createDataFrame([("berlin", "geography", None), ("hip hop", "mood", None)], "tag_norm string, tag_type string, canonical_genre string")
    kinds = {r["tag_norm"]: (r["tag_type"], r["classification_method"]) for r in X.classify_tags(resolved, curated).collect()}
    assert (kinds["berlin"], kinds["hip hop"], kinds["1999"], kinds["80s"], kinds["odd"]) == (("geography", "curated"), ("genre", "exact"), ("era", "era_rule"), ("era", "era_rule"), ("unknown", "unresolved"))
    assert len(kinds) == 9


SCHEMA = "album_id string, artist string, album string, id string, title string, credits array<string>, first_release_date string, primary_type string, score int"


def chosen(spark, data):
    return {r["album_id"]: (r["release_group_mbid"], r["first_release_year"], r["resolution_method"]) for r in D.select_release(spark.createDataFrame(data, SCHEMA)).collect()}


def test_editions(spark):
    cases = {"Name (Big Deluxe Thing)": "Name", "Name [1999 Remaster] ": "Name", "Name (Live)": "Name (Live)", "Name - Mono": "Name - Mono", "Name – 20 Anos": "Name", "A - B - Remix": "A", "Name - (Bonus Disc)": "Name", "(Version)": "", "One (x) Two": "One (x) Two", "": ""}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r for r in df.select("want", D.without_edition(F.col("t")).alias("got"), "t").collect() if r["want"] != r["got"]] == []
    titles = spark.createDataFrame([("“Ação  &  Reação”", "acao and reacao"), ("Straße", "strasse"), ("Øre ‐ x’s", "øre - x's")], "t string, want string")
    assert [r for r in titles.select("want", D.search_title(F.col("t")).alias("got")).collect() if r["want"] != r["got"]] == []


def test_names_fold_by_decomposition(spark):
    from tidemill.functions.text import fold_marks, name_key

    df = spark.createDataFrame([("Dvořák Ğüneş Țepeș", "dvorakgunestepes"), ("Łukasz Øst", "ukaszst"), ("ｆｕｌｌ²", "full2"), ("ß", None)], "t string, want string")
    assert [r for r in df.select("want", name_key(F.col("t")).alias("got")).collect() if r["want"] != r["got"]] == []
    assert spark.createDataFrame([("Łukasz Øst Đuro Ěß",)], "t string").select(fold_marks(F.col("t"))).first()[0] == "lukasz ost duro ess"


def test_copies_of_a_candidate_are_settled(spark):
    data = [("a", "X", "Y", "1", "Y", ["X"], "2001", "Album", 50), ("a", "X", "Y", "1", "Y", ["X"], "1999-01", "Album", 90)]
    assert chosen(spark, data) == chosen(spark, data[::-1]) == {"a": ("1", 1999, "release_group_search")}


def test_selection(spark):
    data = [
        ("a", "Béla", "Dust", "1", "Dust", ["bela"], "1997-05", "Album", 90), ("a", "Béla", "Dust", "2", "Dust: Live", ["Bela"], "1990", "Album", 99),
        ("b", "X", "Y", "3", "Y", ["X"], "2001", "Single", 99), ("b", "X", "Y", "4", "y", ["X"], "2001-02-03", "Album", 50), ("b", "X", "Y", "5", "X - Y", ["X"], None, "Album", 50),
        ("c", "X", "Z", "6", "Z", ["X"], "2001", "Album", 99), ("c", "X", "Z", "7", "Z", ["X"], "2002", "Album", 99),
        ("d", "X", "W (Deluxe Edition)", "8", "W", ["X"], "1980", "Album", 9), ("d", "X", "W (Deluxe Edition)", "9", "W (Deluxe Edition)", ["X"], "2010", "Album", 9),
        ("e", "X", "V", "10", "V", ["Someone"], "1980", "Album", 9), ("f", "X", "“Q & R”", "11", "Q and R / S", ["X"], None, None, None),
    ]
    assert chosen(spark, data) == {"a": ("1", 1997, "release_group_search"), "b": ("4", 2001, "release_group_search_consensus"), "d": ("8", 1980, "release_group_search_variant"), "f": ("11", None, "release_group_search")}
    assert chosen(spark, []) == {}


def test_family_and_cascade(spark):
    releases = spark.createDataFrame([("a", "X", "Y", "G", "Y", "1999-01"), ("a", "X", "Y", "G", "G", "1998"), ("a", "X", "Y", "G", "Other", "1950"), ("a", "X", "Y", "G", "Y", None)], "album_id string, artist string, album string, group_title string, title string, date string")
    assert rows(D.family_first_date(releases)) == [("a", "1998", 2)]
    tier = lambda *r: spark.createDataFrame(r, "album_id string, y int")
    assert rows(D.release_cascade(tier(("a", 1)), tier(("a", 2), ("b", 2)), tier(("b", 3), ("c", 3)))) == [("a", 1), ("b", 2), ("c", 3)]
    dim = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9)], "album_id string, scrobble_count long")
    cache = spark.createDataFrame([("a", "ok"), ("b", "error")], "album_id string, status string")
    assert [r["album_id"] for r in D.enrichment_candidates(dim, cache, "album_id", ["ok", "not_found"], 1).collect()] == ["b"]


def test_generators_repeat_and_hold(spark):
    people = Z.customers(spark, 300)
    lead_rows = Z.leads(people, "2025-01-01", 400).cache()
    assert people.select("email").distinct().count() == people.select("phone").distinct().count() == 300
    assert lead_rows.exceptAll(Z.leads(Z.customers(spark, 300).repartition(7), "2025-01-01", 400)).count() == 0
    assert lead_rows.join(people, "customer_id", "left_anti").count() == 0
    close = lead_rows.alias("a").join(lead_rows.alias("b"), "customer_id").filter("a.lead_id < b.lead_id AND abs(datediff(a.created_at, b.created_at)) < 14")
    assert close.count() == 0
    damaged, log = Z.corrupted(lead_rows, "lead_id", {"email": 0.5, "name": 0.0})
    assert log.filter("field <> 'email'").count() == 0
    assert log.count() == damaged.filter(F.col("email").isNull()).count() > 0
    money = Z.spend(lead_rows, "2025-01-01", 400)
    assert (money.count(), money.filter("spend < 0 OR clicks < 0 OR platform_conversions < 0").count(), money.select("date", "source").distinct().count()) == (800, 0, 800)
