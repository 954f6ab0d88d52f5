from tastegrid.sources import payloads as P


def test_map_elements(spark):
    docs = [
        '{"type":"node","id":"1","lat":1.0,"lon":2.0,"tags":{"name":" A ","amenity":"cafe","cuisine":"north_indian; momo","phone":"1;2"}}',
        '{"type":"way","id":"2","center":{"lat":3.0,"lon":4.0},"tags":{"name":"B","addr:street":"Osk Street","addr:housenumber":"5"}}',
        '{"type":"node","id":"3","lat":1.0,"lon":2.0,"tags":{}}', "not json", None,
    ]
    got = {r["external_id"]: r for r in P.map_elements(spark.createDataFrame([(x,) for x in docs], "json string")).collect()}
    assert set(got) == {"node/1", "way/2"}
    assert got["node/1"]["cuisines"] == ["north indian", "momo", "cafe"] and got["node/1"]["phone"] == "1"
    assert got["way/2"]["lat"] == 3.0 and got["way/2"]["address"] == "5 Osk Street"


def test_cells(spark):
    c = spark.createDataFrame([("a", 22.57, 88.36, 10000)], "id string, lat double, lng double, r int")
    n = P.cells(c, "r", 1000.0).count()
    assert abs(n - 314) < 12
    assert P.cells(c, "r", 1000.0, inner_m=4000.0).count() < n


def test_posts(spark):
    rows = [(1, "t", "x" * 50, 0, "a", 1), (2, "t", "[deleted]", 0, "a", 1), (3, "t", "short", 0, "a", 1), (4, "t", None, 0, "a", None)]
    got = P.posts_to_reviews(spark.createDataFrame(rows, "id long, title string, body string, created long, author string, score int")).collect()
    assert [r["external_id"] for r in got] == ["t3_1"]
