from tastegrid.operators.profiles import profile_chips

SCHEMA = "id string, mentions int, dishes array<struct<name:string,sentiment:double,mentions:int>>, attributes map<string,bigint>, aspects map<string,double>, price_ratio double, consistency double, trend string, cuisines array<string>"


def test_chips(spark):
    momo = [("Prawn Momo", 0.8, 20)]
    rows = [
        ("few", 2, momo, {}, {}, 0.5, 0.9, "rising", ["x"]), ("full", 20, momo, {"spicy": 3, "oily": 2, "late_night": 2}, {"service": 0.6, "hygiene": -0.5, "ambience": 0.4}, 0.75, 0.75, "rising", []),
        ("bare", 5, [], {}, {}, None, None, None, ["North Indian", "Momo", "Tea"]), ("nulls", 5, None, None, None, None, None, None, None), ("edges", 8, [("A", 0.69, 8)], {"spicy": 1}, {"service": -0.4}, 1.4, 0.35, "declining", None),
        ("none", None, None, None, None, None, None, None, None),
    ]
    got = {r["id"]: r["chips"] for r in profile_chips(spark.createDataFrame(rows, SCHEMA), "id").collect()}
    assert got["few"] == [] and got["none"] == [] and got["nulls"] == []
    assert got["full"] == ["strong_prawn_momo", "spicy", "affordable", "consistent", "great_service", "late_night"]
    assert got["bare"] == ["north indian", "momo"]
    assert got["edges"] == ["premium", "inconsistent", "slow_service", "declining"]
