from datetime import datetime, timedelta

from tastegrid.streaming import streams as X

D = datetime(2024, 1, 1)


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_replayed_windows_equal_batch(spark, tmp_path):
    rows = [(i, D + timedelta(minutes=37 * i % 5000), i % 4, "view", 1.0, "{}") for i in range(300)]
    d = write(spark, tmp_path, rows)
    got = X.replay(X.windowed(X.stream(spark, d, "events"), "ts", ["event_type"], "1 hour"), "complete").collect()
    assert sum(r["n"] for r in got) == 300
    want = {}
    for r in rows:
        h = r[1].replace(minute=0)
        want[h] = want.get(h, 0) + 1
    assert {r["window_start"]: r["n"] for r in got} == want


def test_first_deliveries_and_sessions(spark, tmp_path):
    rows = [(i // 2, D + timedelta(minutes=i), 1, "view", 1.0, "{}") for i in range(20)]
    d = write(spark, tmp_path, rows)
    assert X.replay(X.first_deliveries(X.stream(spark, d, "events"), "ts", ["event_id"], "1 day")).count() == 10
    s = X.replay(X.sessions(X.stream(spark, d, "events"), "ts", "user_id", "5 minutes"), "complete").collect()
    assert [(r["user_id"], r["n"]) for r in s] == [(1, 20)]


def test_budgets_ignore_refused_costs(spark, tmp_path):
    rows = [(i, D + timedelta(minutes=i), 7, "view", c, "{}") for i, c in enumerate([60.0, 50.0, 40.0, 1.0])]
    d = write(spark, tmp_path, rows)
    e = X.stream(spark, d, "events").selectExpr("cast(user_id as string) k", "ts", "event_id", "cast(value as long) cost")
    got = X.replay_updates(X.spent_budgets(e, "k", ["ts", "event_id"], "cost", 100), "key").collect()
    assert [(r["key"], r["allowed"], r["refused"], r["spent"]) for r in got] == [("7", 2, 2, 100)]


def test_refused_requests(spark):
    rows = [(1, D + timedelta(minutes=m), i) for i, m in enumerate([0, 10, 119, 120, 500])] + [(2, D, 9), (None, D, 10), (3, None, 11)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")
    assert {r["user_id"]: r["refused"] for r in X.refused_requests(df, "user_id", "ts", "event_id", 2, 1).collect()} == {1: 2, 2: 0}
    assert X.refused_requests(df.limit(0), "user_id", "ts", "event_id", 2, 1).count() == 0
