from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tastegrid.operators import scoring as S
from tastegrid.plans import more
from tastegrid.plans import scores as plans

NOW = datetime(2026, 8, 15)
SCHEMA = "dish_id string, restaurant_id string, city_id string, sentiment double, confidence double, source string, engagement int, published_at timestamp, price double, method string, attributes array<string>"


def obs(spark, rows):
    full = []
    for r in rows:
        x = {"dish_id": "d", "restaurant_id": "r", "city_id": "c", "sentiment": 0.9, "confidence": 0.8, "source": "user", "engagement": 0, "published_at": NOW - timedelta(days=10), "price": None, "method": "ai", "attributes": []} | r
        full.append(tuple(x[k] for k in x))
    return spark.createDataFrame(full, SCHEMA)


def scores(spark, rows):
    return {r["restaurant_id"]: r for r in S.score_pairs(obs(spark, rows), F.lit(NOW)).collect()}


def test_gate(spark):
    s = scores(spark, [{"restaurant_id": "two"}] * 2 + [{"restaurant_id": "three"}] * 3 + [{"restaurant_id": "weak", "confidence": 0.05, "source": "osm"}] * 4)
    assert s["two"]["status"] == "insufficient_data" and s["two"]["score"] is None
    assert s["three"]["status"] == "ranked" and 0 < s["three"]["score"] <= 100
    assert s["weak"]["status"] == "insufficient_data"


def test_many_good_beat_three_perfect(spark):
    s = scores(spark, [{"restaurant_id": "few", "sentiment": 1.0}] * 3 + [{"restaurant_id": "many", "sentiment": 0.75}] * 500)
    assert s["many"]["score"] > s["few"]["score"]


def test_age_halves_and_missing_dates(spark):
    s = scores(spark, [{"restaurant_id": "old", "published_at": NOW - timedelta(days=180)}] * 3 + [{"restaurant_id": "undated", "published_at": None}] * 3 + [{"restaurant_id": "future", "published_at": NOW + timedelta(days=9)}] * 3)
    assert s["old"]["recency"] == 0.5 and s["future"]["recency"] == 1.0
    assert s["undated"]["recency_days"] == 365.0


def test_null_columns_and_zero_price(spark):
    s = scores(spark, [{"sentiment": 0.5, "engagement": None, "source": None, "method": None, "price": 0.0}] * 3)
    assert s["r"]["price_avg"] is None and s["r"]["value_score"] is None and s["r"]["source_quality"] == 0.5


def test_order_of_rows_does_not_matter(spark):
    rows = [{"restaurant_id": f"r{i % 3}", "sentiment": (i % 7) / 7, "price": 10.0 + i} for i in range(40)]
    assert scores(spark, rows) == scores(spark, rows[::-1])


def test_badges(spark):
    schema = "dish_id string, restaurant_id string, city_id string, status string, mention_count int, consistency double, value_score double, observed_positivity double"
    rows = [("d", "a", "c", "ranked", 4, 0.9, 0.5, 0.95), ("d", "b", "c", "ranked", 40, 0.8, 0.7, 0.9), ("d", "e", "c", "ranked", 80, 0.8, 0.7, 0.9), ("d", "x", "c", "insufficient_data", 1, 1.0, 1.0, 1.0)]
    b = {r["restaurant_id"]: r for r in S.badges(spark.createDataFrame(rows, schema)).collect()}
    assert set(b) == {"a", "b", "e"}
    assert b["a"]["hidden_gem"] and not b["b"]["hidden_gem"]
    assert b["b"]["best_value"] and not b["e"]["best_value"]  # a tie goes to the smaller id
    assert b["b"]["most_consistent"] and not b["a"]["most_consistent"]  # four mentions are too few


def test_trend(spark):
    def run(recent, past):
        rows = [{"sentiment": s, "published_at": NOW - timedelta(days=5)} for s in recent] + [{"sentiment": s, "published_at": NOW - timedelta(days=100)} for s in past] + [{"published_at": None}, {"published_at": NOW + timedelta(days=1)}, {"published_at": NOW - timedelta(days=300)}]
        return S.trends(obs(spark, rows), ["restaurant_id"], F.lit(NOW)).collect()[0]

    assert run([1.0] * 2, [0.0] * 2)["direction"] is None
    assert run([0.9] * 3, [-0.9] * 3)["direction"] == "rising"
    assert run([-0.9] * 3, [0.9] * 3)["direction"] == "declining"
    assert run([0.5] * 3, [0.5] * 9)["direction"] == "stable"
    surge = run([0.5] * 39, [0.5] * 3)
    assert surge["direction"] == "rising" and not surge["significant"]


def test_upsert_keeps_null_keys(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, m string, v int")
    new = spark.createDataFrame([("a", None, 9)], "k string, m string, v int")
    assert sorted(r["v"] for r in S.upsert(old, new, ["k", "m"]).collect()) == [2, 9]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.score_pairs(none, F.lit(NOW)).count() == 0 and S.pair_rollup(none).count() == 0


HALF = [56.349, 58.68, 55.232, 57.413]  # their mean is exactly half way, at 56.9185; sums of doubles end below it


def test_mean_scores_of_cards_round_halves_up(spark, monkeypatch):
    rows = [("d", "c", "ranked", x, 1, 5.0) for x in HALF]
    monkeypatch.setattr(plans, "_scores", lambda *_: spark.createDataFrame(rows, "dish_id string, city_id string, status string, score double, mention_count long, price_avg double"))
    assert [(r["score"], r["places"]) for r in plans.agg11_dish_cards(spark, "").collect()] == [(56.919, 4)]


def test_mean_scores_of_restaurants_round_halves_up(spark):
    rows = [("r", "ranked", x, 1) for x in HALF] + [("r", "insufficient_data", None, 1)]
    out = more._restaurant_scores(spark.createDataFrame(rows, "restaurant_id string, status string, score double, mention_count long")).collect()
    assert [(r["score"], r["mentions"]) for r in out] == [(56.919, 4)]
