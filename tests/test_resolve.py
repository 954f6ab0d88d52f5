from pyspark.sql import functions as F

from tastegrid.operators import keeping as K
from tastegrid.operators.parse import parse_queries
from tastegrid.operators.resolve import name_similarity, resolve

CAT = "id string, normalized_name string, lat double, lng double, aliases array<string>, source_keys array<struct<source:string,external_id:string>>"
INC = "row_id string, name string, lat double, lng double, source string, external_id string"
CATALOGUE = [
    ("r1", "wok orbit noodle bar", 22.50, 88.30, [], [("osm", "n1")]), ("r2", "wok orbit noodle bar", 22.57, 88.30, ["Orbit"], []), ("r3", "abelur bakery", 22.60, 88.30, ["The Abelur"], []),
    ("r4", "twin stall", 22.70, 88.30, [], []), ("r5", "twin stall", 22.70, 88.30, [], []), ("r6", "nowhere inn", None, None, None, None),
]


def run(spark, rows):
    return {r["row_id"]: r for r in resolve(spark.createDataFrame(rows, INC), spark.createDataFrame(CATALOGUE, CAT)).collect()}


def test_tiers(spark):
    got = run(spark, [
        ("key", "anything", 0.0, 1.0, "osm", "n1"), ("exact", "Wok Orbit Noodle Bar", 22.5001, 88.3, "google", "x"), ("branch", "Wok Orbit Noodle Bar", 22.5701, 88.3, "google", "x"), ("alias", "The Abelur", 22.604, 88.3, None, None),
        ("far", "Abelur Bakery", 22.9, 88.3, None, None), ("tie", "Twin Stall", 22.7, 88.3, None, None), ("fuzzy", "Abelurr Bakery", 22.6005, 88.3, None, None), ("blank", " ", 22.6, 88.3, None, None), ("null", None, None, None, None, None),
        ("unplaced", "Abelur Bakery", None, None, None, None), ("unplaced2", "Abelur Cafe", None, None, None, None),
    ])
    assert (got["key"]["matched_id"], got["key"]["confidence"]) == ("r1", 1.0)
    assert (got["exact"]["matched_id"], got["exact"]["confidence"]) == ("r1", 0.95) and got["branch"]["matched_id"] == "r2"
    assert (got["alias"]["method"], got["alias"]["matched_id"]) == ("alias", "r3")
    assert (got["far"]["method"], got["far"]["confidence"]) == ("new", 0.3)
    assert got["tie"]["method"] == "ambiguous" and got["tie"]["matched_id"] is None and got["tie"]["runner_up_id"] == "r5"
    assert got["fuzzy"]["method"] == "fuzzy_geo" and got["blank"]["confidence"] == 0.0 and got["null"]["confidence"] == 0.0
    assert (got["unplaced"]["method"], got["unplaced"]["confidence"]) == ("fuzzy_strict", 0.85) and got["unplaced2"]["method"] == "new"


def test_similarity(spark):
    x = spark.createDataFrame([("wow momo", "wow momo salt lake"), ("", "a"), (None, "a"), ("same", "same")], "a string, b string").select(name_similarity("a", "b").alias("s")).collect()
    assert [r["s"] for r in x] == [0.85, 0.0, 0.0, 1.0]


def test_upkeep(spark):
    df = spark.createDataFrame([("c", "1", "A b"), ("c", "2", "a B"), ("d", "3", "A b"), ("c", "4", None)], "city string, id string, name string")
    assert {r["id"]: r["slug"] for r in K.unique_slugs(df, ["city"], "name", "id").collect()} == {"1": "a-b", "2": "a-b-2", "3": "a-b", "4": "item"}
    old = spark.createDataFrame([("s", "1", "x", "p"), ("s", "2", "y", None)], "source string, external_id string, name string, phone string")
    new = spark.createDataFrame([("s", "1", "", "q"), ("s", "2", "y", None), ("s", "3", "z", None)], old.schema)
    got = {r["external_id"]: (r["name"], r["phone"], r["action"]) for r in K.upsert_places(old, new, ["name", "phone"]).collect()}
    assert got == {"1": ("x", "q", "updated"), "2": ("y", None, "skipped"), "3": ("z", None, "created")}
    facts = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    assert sorted((r["k"] or "", r["v"]) for r in K.merge_entities(facts, "k", spark.createDataFrame([("a", "b")], "loser string, winner string")).collect()) == [("", 3), ("b", 1), ("b", 2)]


def test_grounding(spark):
    df = spark.createDataFrame([("the soup was warm", "Well, the soup was warm."), ("the soup was cold and grey", "the soup was warm"), (None, "x"), ("x", None)], "a string, b string")
    assert [r["g"] for r in df.select(K.grounded("a", "b").alias("g")).collect()] == [True, False, False, False]
    kept = spark.range(1).select(K.drop_unsupported(F.lit("It is crispy. It is smoky. Fine."), F.array(F.lit("smoky")), ["crispy", "smoky"]).alias("x")).collect()[0]["x"]
    assert kept == "It is smoky. Fine"


def test_parse(spark):
    df = spark.createDataFrame([(1, "Best momo near me"), (2, "biryani between 200 and 400 in Palm Circle"), (3, "dosa under 150"), (4, "")], "id int, q string")
    got = {r["id"]: r for r in parse_queries(df, "id", "q").collect()}
    assert got[1]["superlative"] and got[1]["near_me"] and (got[2]["min_price"], got[2]["max_price"], got[2]["area"]) == (200, 400, "palm circle")
    assert got[3]["max_price"] == 150 and got[4]["dish"] == ""
