"""The training-data operators on small fixtures: brute force, invariants, odd rows."""

import itertools
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import langid, linkage, mixing, models, packing, pii, safety, truncation
from tastegrid.llm.chartagger import CharTagger, encode
from tastegrid.llm.tokens import token_counts
from tastegrid.llm.top_n import latest, top_n


# --- top N ---------------------------------------------------------------------------------------------------------
TOP = "g string, h string, s double, m int, id string, count int, rank int"


def top_brute(rows, n):
    best = {}
    for r in rows:
        best.setdefault(r[:2], []).append(r)
    key = lambda r: (r[2] is None or r[2] != r[2], -(r[2] or 0) if r[2] == r[2] and r[2] is not None else 0, r[3] is None, -(r[3] or 0), r[4] is None, r[4] or "")
    return {(g, i + 1, r[4]) for g, rs in best.items() for i, r in enumerate(sorted(rs, key=key)[:n])}


@pytest.mark.parametrize("hot", [0.1, 1.5, 10**6])
def test_top_n_equals_brute_force(spark, hot):
    r = random.Random(int(hot * 10))
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice(["x", None]), r.choice([1.0, 2.0, 2.0, 50.0, r.random() * 100, None, float("nan")]), r.choice([1, 2, None]), f"i{i:04d}", 1, 1) for i in range(400)]
    got = top_n(spark.createDataFrame(rows, TOP), ["g", "h"], "s", [F.col("m").desc_nulls_last(), F.col("id").asc_nulls_last()], 3, "id", times=hot)
    found = [((x["g"], x["h"]), x["rank"], x["id"]) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == top_brute(rows, 3)


def test_top_n_all_tied_and_empty(spark):
    rows = [("a", "x", 7.0, 1, f"i{i:03d}", 1, 1) for i in range(60)]
    df = spark.createDataFrame(rows, TOP)
    got = top_n(df, ["g", "h"], "s", [F.col("id")], 2, "id", most_rows=10).collect()
    assert sorted(x["id"] for x in got) == ["i000", "i001"]
    assert top_n(df.limit(0), ["g", "h"], "s", [F.col("id")], 2, "id").count() == 0
    assert latest(df, ["g"], [F.col("id").desc()], ["s"]).collect()[0]["s"] == 7.0


# --- personal information --------------------------------------------------------------------------------------------
def test_tagger_learns_and_windows_agree():
    r = random.Random(1)
    words = "the soup was warm and bread came late near old gate".split()
    texts, ys = [], []
    for _ in range(600):
        a, b = " ".join(r.choices(words, k=r.randint(1, 4))), " ".join(r.choices(words, k=r.randint(1, 4)))
        num = "".join(r.choices("0123456789", k=8)) if r.random() < 0.6 else ""
        t = f"{a} {num} {b}"
        y = np.zeros(len(t), np.int8)
        if num:
            y[len(a) + 1 : len(a) + 9] = 2
            y[len(a) + 1] = 1
        texts.append(t)
        ys.append(y)
    model = CharTagger(3, hidden=12, seed=3)
    loss = pii._fit(model, texts[:500], ys[:500], 60, 0.02, 1)
    assert loss[-1] < 0.1 * loss[0]
    wrong = sum((p != y).any() for p, y in zip(model.tag(texts[500:]), ys[500:]))
    assert wrong <= 5
    long = " ".join(texts[:60])
    whole, parts = model.tag([long])[0], np.concatenate(ys[:60])
    assert (whole > 0).sum() and abs(int((whole > 0).sum()) - int((parts > 0).sum())) < 0.1 * (parts > 0).sum()
    assert [len(p) for p in model.tag(["", "a"])] == [0, 1]


def test_crf_gradient():
    m = CharTagger(4, hidden=3, seed=1)
    r = np.random.default_rng(0)
    m.p["trans"] = r.normal(size=(4, 4)).astype(np.float32)
    e, y, ls = r.normal(size=(3, 5, 4)).astype(np.float32), r.integers(0, 4, size=(3, 5)).astype(np.int8), np.array([5, 3, 1])
    nll, de, dt, _ = m._crf_grad(e, y, ls)
    for b in range(3):  # the likelihood against all paths
        n = ls[b]
        score = lambda path: m.p["start"][path[0]] + sum(e[b, t, path[t]] for t in range(n)) + sum(m.p["trans"][path[t - 1], path[t]] for t in range(1, n))
        z = np.logaddexp.reduce([score(p) for p in itertools.product(range(4), repeat=int(n))])
        assert abs((z - score(y[b, :n])) - nll[b]) < 1e-3
    e2 = e.copy()
    e2[0, 2, 1] += 1e-2
    assert abs((m._crf_grad(e2, y, ls)[0][0] - nll[0]) / 1e-2 - de[0, 2, 1]) < 2e-2
    m.p["trans"][1, 2] += 1e-2
    assert abs((m._crf_grad(e, y, ls)[0].sum() - nll.sum()) / 1e-2 - dt[1, 2]) < 5e-2


def test_encode_folds():
    ids, at = encode(["é２​", "", "अ"])
    assert ids[0] == ord("e") and ids[1] == ord("2") and list(at) == [0, 3, 3, 4]


def test_label_patterns():
    p = pii._names_pattern({"keldra", "bosrala"})
    kinds = lambda t: [pii.KINDS[k] for _, _, k in pii.label_spans(t, p)]
    assert kinds("Write to keldra.x@mail.example or 07700 900165") == ["email", "phone"]
    assert kinds("my card 000-01-4567, I live at 98 Gannet Avenue") == ["id_number", "address"]
    assert kinds("Ask for Mr. Keldra T. Bosrala please") == ["name"]
    assert kinds("The Old Bosrala Grill, order no 3945 4089 4982, pin 22.5199, 88.3199") == []
    assert pii.grow_names({"Keldra"}, ["Keldra Orvane", "Debrok, Orvane", "Night Notes"]) == {"keldra", "orvane", "debrok"}


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([("a", "call 123 or x@y now", [{"start": 5, "stop": 8, "kind": "phone"}, {"start": 12, "stop": 15, "kind": "email"}]), ("b", "nothing", []), ("c", None, [])], "id string, t string, t_spans array<struct<start:int,stop:int,kind:string>>")
    got = {r["id"]: r["x"] for r in df.select("id", pii.redacted("t").alias("x")).collect()}
    assert got == {"a": "call [PHONE] or [EMAIL] now", "b": "nothing", "c": None}


def test_tag_fields_odd_rows(spark):
    m = CharTagger(2 * len(pii.KINDS) + 1, hidden=4)
    df = spark.createDataFrame([("a", None, "", 1), ("b", "x" * 5000, None, 2)], "id string, text string, author string, start int")
    got = pii.tag_fields(df, "id", ["text", "author"], m).collect()
    assert {r["id"] for r in got} == {"a", "b"} and all(r["author_spans"] == [] for r in got)
    assert pii.tag_fields(df.limit(0), "id", ["text"], m).count() == 0


# --- safety ------------------------------------------------------------------------------------------------------------
def test_plain_words():
    assert safety.plain_words("You 1d10t, N u d e veeermiiin") == ["you", "idiot", "nude", "vermin"]
    assert safety.plain_words("bеwаkооf pi​gs") == ["bewakoof", "pigs"]
    assert safety.skeleton("id**t") == safety.skeleton("idiot") and safety.plain_words("") == []


def test_interactions_are_learnt():
    rows = [["cook", "pig"], ["cook", "good"], ["roast", "pig"], ["roast", "good"]]
    x = [safety.terms(" ".join(r)) for r in rows] * 50
    y = np.array([1.0, 0, 0, 0] * 50)
    m = safety.FactorizationMachine()
    m.fit(x, y, np.ones(len(y)), epochs=40)
    assert (m.score(x) > 0.5).tolist() == (y > 0.5).tolist()
    # whatever lies between the two words
    long = ["cook " + " ".join(f"w{i}x" for i in range(300)) + " pig"]
    own = safety.terms(long[0])
    assert len(own) > 300 and m.score([own, []]).shape == (2,)
    v, n = m.v[own], len(own)
    pairs = 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()) / n
    assert abs(np.log(m.score([own])[0] / (1 - m.score([own])[0])) - (m.b + m.w[own].sum() / n**0.5 + pairs)) < 1e-3


def test_fit_survives_noise_and_odd_rows(spark):
    r = random.Random(2)
    good = ["the soup was warm", "bread came late", "we paid ten for tea", "the gate is near", "service was slow today"]
    bad = ["you rotten idiot", "what a filthy pig you are", "shut up you worthless idiot"]
    texts, ys = [], []
    for _ in range(500):
        u = r.random() < 0.2
        s = [r.choice(good) for _ in range(3)]
        if u:
            s[r.randrange(3)] = r.choice(bad)
        texts.append(". ".join(s) + ".")
        ys.append(int(u != (r.random() < 0.03)))
    m = safety.fit(texts, ys, texts)
    df = spark.createDataFrame([("a", "bread came late. You filthy idiot."), ("b", "the soup was warm."), ("c", None), ("d", "")], "id string, text string")
    got = {x["id"]: x["score"] for x in safety.score_texts(df, "id", "text", m).collect()}
    assert got["a"] > 0.5 > got["b"] and got["c"] == got["d"] == 0.0
    assert safety.fit(texts, [0] * len(texts), []) is None
    assert {x["score"] for x in safety.score_texts(df, "id", "text", None).collect()} == {0.0}


# --- languages ---------------------------------------------------------------------------------------------------------
EN, DE, HI = "the table is near the old gate and we like it", "das Essen war sehr gut und die Soße kam warm", "यहाँ की सेवा तेज़ है और भीड़ भी रहती है"


def language_model():
    cut = lambda s: [" ".join(s.split()[i : i + 5]) for i in range(0, len(s.split()) - 4)]
    texts = cut(EN) * 10 + cut(DE) * 10 + cut(HI) * 10
    labels = ["en"] * len(cut(EN) * 10) + ["de"] * len(cut(DE) * 10) + ["hi"] * len(cut(HI) * 10)
    labels[::9] = ["fr"] * len(labels[::9])  # wrong labels
    return langid.Languages.train(texts, labels)


def test_languages(spark):
    rows = [("a", EN + "."), ("b", f"{EN}. {DE}."), ("c", "5/5 🔥 https://x.example/abc"), ("d", None), ("e", ""), ("f", (HI + "। ") * 300)]
    got = langid.detect(spark.createDataFrame(rows, "id string, text string"), "id", "text", language_model()).collect()
    found = {(r["id"], r["language"]) for r in got}
    assert found == {("a", "en"), ("b", "en"), ("b", "de"), ("f", "hi")}
    b = next(r for r in got if r["id"] == "b" and r["language"] == "de")
    assert rows[1][1][b["segments"][0]["start"] : b["segments"][0]["stop"]].startswith("das Essen") and 0.4 < b["share"] < 0.6


def test_labels(spark):
    names = ["en-IN", "EN", " hi_IN", "hi-latn", "und", "", None, "unknown", "bn_Latn"]
    df = spark.createDataFrame([(n,) for n in names], "l string").select(langid.label_of(F.col("l")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["en", "en", "hi", "hi-Latn", None, None, None, None, "bn-Latn"]


def test_sentences_lose_nothing():
    for t in ["A b c. D e f! Rs. 20 for it.\n\nx", "", "...", "Mr. X came by today. ok"]:
        s = langid.sentences(t)
        assert "".join(t[a:b] for a, b in s) == t


# --- truncation --------------------------------------------------------------------------------------------------------
def test_endings():
    assert truncation.ending("All was fine.")[0] == "closed" and truncation.ending("fine 🔥")[0] == "closed"
    assert truncation.ending("The soup was [more]")[0] == "broken" and truncation.ending("Tom &am")[0] == "broken"
    assert truncation.ending("It cost Rs.")[0] == "open" and truncation.ending("")[0] == "closed"
    assert truncation.ending("see https://clips.exa/x1", False)[0] == "broken" and truncation.ending("see https://clips.example/x1", True)[0] == "closed"
    far = "It all began well. " + "and so on " * 5000
    assert truncation.ending(far) == ("open", far[19:].rstrip()) and truncation.strip_end("x" + " ... read more" * 40)[0] == "x"
    assert truncation.ending("word " * 300 + "https://clips.example/" + "y" * 900)[0] == "closed"


def test_truncated_texts(spark):
    r = random.Random(4)
    subject, verb, rest = ["the soup", "my aunt", "our driver", "the old cook", "a waiter"], ["liked", "tried", "praised", "carried", "warmed"], ["the bread at noon", "every dish on the menu", "tea near the gate", "rice with ginger"]
    fill = "so very much that we all came again with a few old friends from work".split()  # lengths of every size
    sent = lambda: f"{r.choice(subject).capitalize()} {r.choice(verb)} {' '.join(r.choices(fill, k=r.randint(0, 9)))} {r.choice(rest)}"
    rows = []
    for i in range(900):
        t = ". ".join(sent() for _ in range(r.randint(2, 6)))
        if i % 3 == 0 and len(t) > 100:
            rows.append((i, t[:100], "a", True))
        else:
            rows.append((i, t + r.choice([".", ".", ""]), "a" if i % 2 else None, False))
    rows += [(9001, None, "a", False), (9002, "", None, False)]
    df = spark.createDataFrame(rows, "id int, text string, source string, cut boolean").withColumn("chars", F.length("text"))
    got = truncation.flag(df, "id", "text", "source", "chars", truncation.fit([x[1] for x in rows if x[1]]))
    peaks = truncation.significant_lengths(df, "source", "chars").collect()
    assert {(p["source"], p["pooled"], p["length"]) for p in peaks} == {("a", False, 100), (None, True, 100)}
    truth = {x[0]: x[3] for x in rows}
    out = got.collect()
    assert len(out) == len(rows)
    hit = {x["id"] for x in out if x["truncated"]}
    assert {x["length"] for x in out if x["at_limit"]} == {100}
    cut = {i for i, c in truth.items() if c}
    assert len(hit & cut) > 0.85 * len(cut) and len(hit - cut) < 0.05 * len(rows)


# --- packing -----------------------------------------------------------------------------------------------------------
def test_fill_is_optimal():
    r = random.Random(6)
    for _ in range(150):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(0, 5))}
        room = r.randint(0, 60)
        items = [s for s, c in counts.items() for _ in range(c)]
        best = max(sum(x) for k in range(len(items) + 1) for x in itertools.combinations(items, k) if sum(x) <= room)
        used = packing.fill(counts, room)
        assert sum(s * n for s, n in used.items()) == best and all(n <= counts[s] for s, n in used.items())


def test_packs_everything_once(spark):
    r = random.Random(8)
    rows = [(i, r.choice([1, 5, 17, 40, 64, 100, 130, r.randint(1, 300)]), "x") for i in range(500)] + [(900, 0, "x"), (901, None, "x")]
    kinds = spark.createDataFrame([("s", 64), ("l", 256), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    items = spark.createDataFrame(rows, "doc_id int, tokens int, part string")
    got = packing.pack_items(items, "doc_id", "tokens", kinds, window=120)
    for kind, cap in (("s", 64), ("l", 256)):
        mine = [x for x in got.collect() if x["container_kind"] == kind]
        per, boxes = {}, {}
        for x in mine:
            per.setdefault(x["doc_id"], []).append(x["tokens"])
            boxes[x["container_id"]] = boxes.get(x["container_id"], 0) + x["tokens"]
        assert {i: sum(v) for i, v in per.items()} == {i: s for i, s, _ in rows if s}
        assert all(len(v) == -(-dict((a, b) for a, b, _ in rows)[i] // cap) for i, v in per.items())
        assert max(boxes.values()) <= cap
    assert {x["container_kind"]: x["fill"] > 0.9 for x in packing.fill_rates(got, kinds).collect()} == {"s": True, "l": True}
    assert packing.pack_items(items.limit(0), "doc_id", "tokens", kinds).count() == 0


# --- mixing ------------------------------------------------------------------------------------------------------------
def test_budgets_go_to_siblings_first():
    leaves = [("a", "en", 1000.0), ("b", "en", 10.0), ("c", "en", 1000.0)]
    targets = {"a": (0.25, 1), "b": (0.25, 2), "c": (0.5, 1)}
    got = mixing.budgets(leaves, targets, {"a": "x", "b": "x", "c": "y"}, total=400)
    assert got[("b", "en")] == 20 and abs(got[("a", "en")] - 180) < 1e-6 and abs(got[("c", "en")] - 200) < 1e-6
    got = mixing.budgets(leaves, targets, {"a": "x", "b": "x", "c": "y"}, total=10_000)
    assert got == {("a", "en"): 1000, ("b", "en"): 20, ("c", "en"): 1000}
    # a source short in one language leaves the rest to the other source of that language before other languages
    leaves = [("a", "en", 1000.0), ("a", "de", 1000.0), ("b", "en", 10.0), ("b", "de", 10.0)]
    got = mixing.budgets(leaves, {"a": (0.5, 1), "b": (0.5, 1)}, {"a": "x", "b": "x"}, total=400)
    assert got[("b", "en")] == 10 and abs(got[("a", "en")] - 190) < 1e-6 and abs(sum(got.values()) - 400) < 1e-6


def test_too_many_leaves_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_LEAVES", 2)
    df = spark.createDataFrame([(i, "a", f"l{i}", 5) for i in range(4)], "doc_id int, source string, lang string, tokens int")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mixing.mix(df, "doc_id", "source", "lang", "tokens", t, {})


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, r.choice("aaab"), r.choice(["en", None]), r.choice([5, 10, 20, 0, None])) for i in range(3000)] + [(9999, "z", "en", 50), (9998, None, "en", 50)]
    df = spark.createDataFrame(rows, "doc_id int, source string, lang string, tokens int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("q", 0.0, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, "doc_id", "source", "lang", "tokens", t, {}, total=12_000)
    out = m.collect()
    assert len({x["doc_id"] for x in out}) == len(out) and {x["source"] for x in out} == {"a", "b"}
    assert all(x["repeats"] <= {"a": 1, "b": 2}[x["source"]] for x in out)
    got = {x["source"]: x["share"] for x in mixing.shares(m, t).collect()}
    assert abs(got["a"] - 0.5) < 0.01 and abs(got["b"] - 0.5) < 0.01 and got["q"] == 0
    assert sorted(x["doc_id"] for x in mixing.mix(df, "doc_id", "source", "lang", "tokens", t, {}, total=12_000).collect()) == sorted(x["doc_id"] for x in out)
    assert mixing.mix(df.limit(0), "doc_id", "source", "lang", "tokens", t, {}).count() == 0


# --- linkage -----------------------------------------------------------------------------------------------------------
PLACES = "place_id string, source string, external_id string, name string, lat double, lng double, address string, phone string, fetched_at timestamp"
REVIEWS = "raw_id string, restaurant_hint string, city_id string, lat double, lng double"


def test_linkage(spark):
    t = datetime(2026, 1, 1)
    common = [(f"pl-{i:03d}", "osm", f"n{i}", f"{n} Bakery", 22.0 + i * 0.004, 88.0, None, None, t) for i, n in enumerate("Abelur Bodekin Cadvor Dimuzel Efrono Fubakit Gorimel Hanubo Ikrasel Jutovar".split())]
    rows = common + [
        ("pl-100", "google", "g1", "abelur bakery", 22.0001, 88.0001, None, None, t), ("pl-101", "google", "g1", "abelur bakery", 22.0001, 88.0001, None, None, t),  # fetched twice
        ("pl-102", "google", "g2", "Bodekinn", 22.0041, 88.0001, None, None, t), ("pl-103", "google", "g3", "Cadvor Grill", 22.0081, 88.0001, "5 Osk Street", None, t),
        ("pl-104", "manual", "m1", "The Abelur Bakery", 22.0002, 88.0, None, None, t), ("pl-105", "google", "g5", None, 22.0, 88.0, None, None, t), ("pl-106", "manual", "m2", "Dimuzel Bakery", 88.0, 22.0121, None, None, t),
    ] + [(f"pl-2{i:02d}", "google", f"x{i}", f"Zz{'aeiou'[i % 5]}{i}q Grill", 22.1 + i * 0.004, 88.1, None, None, t) for i in range(8)]
    reviews = [("rv-1", "Abelur Bakery", "ct", None, None), ("rv-2", "some joint", "ct", None, None), ("rv-3", "Bodekin", "ct", 22.0042, 88.0), ("rv-4", None, "ct", 22.0, 88.0), ("rv-5", " ", None, None, None)]
    cities = spark.createDataFrame([("ct", 22.0, 88.0, 30000)], "id string, lat double, lng double, radius_m int")
    matches, members, mentions = linkage.link(spark.createDataFrame(rows, PLACES), spark.createDataFrame(reviews, REVIEWS), cities)
    best = matches.where("confidence > 0.5")
    a, b = members.select(F.col("rid").alias("a"), F.col("place_id").alias("x")), members.select(F.col("rid").alias("b"), F.col("place_id").alias("y"))
    pairs = {tuple(sorted((r["x"], r["y"]))) for r in best.where("not hint").join(a, "a").join(b, "b").collect()}
    assert {("pl-000", "pl-100"), ("pl-000", "pl-101"), ("pl-000", "pl-104"), ("pl-001", "pl-102")} <= pairs
    assert ("pl-002", "pl-103") not in pairs and not any("pl-105" in p for p in pairs)
    assert ("pl-003", "pl-106") in pairs  # its coordinates were swapped
    hints = {(r["raw_id"], r["y"]) for r in best.where("hint").join(mentions.select(F.col("rid").alias("a"), "raw_id"), "a").join(b, "b").collect()}
    assert ("rv-1", "pl-000") in hints and ("rv-3", "pl-001") in hints and not any(h[0] in ("rv-2", "rv-4", "rv-5") for h in hints)
    assert all(0 <= r["confidence"] <= 1 for r in matches.collect())


def _linked(spark, rows, reviews):
    """Pairs of place_ids, and of raw_id and place_id, with a confidence above 0.5."""
    cities = spark.createDataFrame([("ct", 22.0, 88.0, 30000), ("far", 51.0, 2.0, 30000)], "id string, lat double, lng double, radius_m int")
    matches, members, mentions = linkage.link(spark.createDataFrame(rows, PLACES), spark.createDataFrame(reviews, REVIEWS), cities)
    best = matches.where("confidence > 0.5")
    a, b = members.select(F.col("rid").alias("a"), F.col("place_id").alias("x")), members.select(F.col("rid").alias("b"), F.col("place_id").alias("y"))
    pairs = {tuple(sorted((r["x"], r["y"]))) for r in best.where("not hint").join(a, "a").join(b, "b").collect()}
    return pairs, {(r["raw_id"], r["y"]) for r in best.where("hint").join(mentions.select(F.col("rid").alias("a"), "raw_id"), "a").join(b, "b").collect()}


def _bakeries():
    t = datetime(2026, 1, 1)
    return [(f"pl-{i:03d}", "osm", f"n{i}", f"{n} Bakery", 22.0 + i * 0.004, 88.0, None, None, t) for i, n in enumerate("Abelur Bodekin Cadvor Dimuzel Efrono Fubakit Gorimel Hanubo Ikrasel Jutovar".split())]


def test_linkage_hints_of_places_without_coordinates(spark):
    t = datetime(2026, 1, 1)
    rows = _bakeries() + [
        ("pl-100", "google", "g0", "Abelur Bakery", None, None, None, None, t), ("pl-101", "google", "g1", "Bodekin Bakery", 0.0, 0.0, None, None, t),
        ("pl-102", "google", "g2", "Zumirak Bakery", None, None, None, None, t),
    ]
    reviews = [
        ("rv-1", "Abelur Bakery", "ct", None, None), ("rv-2", "Bodekin", "ct", 22.0041, 88.0), ("rv-3", "Zumirak", "ct", None, None),
        ("rv-4", "Abelur Bakery", "far", None, None), ("rv-5", "Bodekin", "far", 51.0, 2.0), ("rv-6", "Cadvor", "ct", None, None),
    ]
    pairs, hints = _linked(spark, rows, reviews)
    assert {("pl-000", "pl-100"), ("pl-001", "pl-101")} <= pairs
    assert {("rv-1", "pl-000"), ("rv-1", "pl-100"), ("rv-2", "pl-001"), ("rv-2", "pl-101"), ("rv-3", "pl-102"), ("rv-6", "pl-002")} == hints


def test_linkage_misspelt_places_without_coordinates(spark):
    t = datetime(2026, 1, 1)
    rows = _bakeries() + [
        ("pl-010", "osm", "n10", "Nizizer Bakery", 22.05, 88.0, None, None, t), ("pl-011", "osm", "n11", "Klebulon Bakery", 22.06, 88.0, "7 Osk Street", None, t), ("pl-012", "osm", "n12", "Bodekim Bakery", 22.08, 88.0, None, None, t),
        ("pl-100", "google", "g0", "Nijizer Bakery", None, None, None, None, t), ("pl-101", "google", "g1", "Kelevullun Bakery", None, None, "7 Osk St, North Yard", None, t),
        ("pl-102", "google", "g2", "Bodekin Bakery", None, None, None, None, t), ("pl-103", "google", "g3", "Zumirak Bakery", None, None, "7 Osk Street", None, t),
    ]
    pairs, _ = _linked(spark, rows, [("rv-1", "Abelur Bakery", "ct", None, None)])
    assert pairs == {("pl-010", "pl-100"), ("pl-011", "pl-101"), ("pl-001", "pl-102")}


def test_linkage_frequent_names_without_coordinates(spark):
    t = datetime(2026, 1, 1)
    rows = _bakeries() + [(f"pl-2{i:02d}", "osm", f"z{i}", "Zumirak Grill", 22.1 + i * 0.004, 88.1, None, None, t) for i in range(13)] + [
        ("pl-010", "osm", "n10", "Zumirak Bakery", 22.05, 88.0, None, None, t), ("pl-100", "google", "g0", "Zumirak Bakery", None, None, None, None, t), ("pl-101", "google", "g1", "Zumirak Grill", None, None, None, None, t),
    ]
    pairs, _ = _linked(spark, rows, [("rv-1", "Abelur Bakery", "ct", None, None)])
    assert pairs == {("pl-010", "pl-100")}  # which of the grills is meant stays open


def test_linkage_hints_of_names_in_many_cells_by_chance(spark):
    t = datetime(2026, 1, 1)
    kinds = "Grill Cafe Snacks Dhaba Eatery Kitchen".split()
    plain = [(f"pl-{k}{i}", "osm", f"k{k}{i}", f"{n} {kind}", 22.0 + i * 0.004, 88.1 + k * 0.01, None, None, t) for k, kind in enumerate(kinds) for i, n in enumerate("Poluvar Quemabo Rustikel Sivanor Tarkemi".split())]
    rows = plain + _bakeries() + [(f"pl-9{k}", "osm", f"z{k}", f"Zumirak {kind}", 22.0 + 3 * k, 88.0 + 3 * k, None, None, t) for k, kind in enumerate(kinds)]
    rows += [(f"pl-8{k}", "osm", f"w{k}", "Wexolit Grill", 22.0 + 3 * k, 88.2 + 3 * k, None, None, t) for k in range(5)]
    _, hints = _linked(spark, rows, [("rv-1", "Zumirak Grill", "ct", None, None), ("rv-2", "Wexolit Grill", "ct", None, None)])
    assert hints == {("rv-1", "pl-90")}  # a name that six kinds of business bear by chance; the other is a chain


def test_admm_solves_a_known_problem(spark):
    # two variables wanting 1 that may add up to 1 at most: the stronger pull wins
    v = spark.createDataFrame([(1, 4.0, 1.0, 0.5, 0.0), (2, 2.0, 1.0, 0.5, 0.0), (3, 1.0, 0.8, 0.2, 0.0)], "var long, up double, up_to double, down double, down_from double")
    rules = spark.createDataFrame([("one", 1, 1.0, 8.0, -1.0), ("one", 2, 1.0, 8.0, -1.0)], "rule string, var long, c double, w double, b double")
    residuals = []
    got = {r["var"]: r["value"] for r in linkage.admm(v, rules, tolerance=1e-3, residuals=residuals).collect()}
    assert got[1] > 0.9 and got[2] < 0.1 and abs(got[3] - 0.8) < 0.02
    assert residuals[-1][1] <= 1e-3 and residuals[-1][2] <= 1e-3
    with pytest.warns(UserWarning, match="no minimum"):
        linkage.admm(v, rules, least_rounds=2, most_rounds=2, tolerance=1e-9)


def test_names_of_any_length_are_compared_whole():
    one = lambda a, b: linkage._compare_names(*[pd.Series([x]) for x in (a, b, [], [], a.replace(" ", ""), b.replace(" ", ""))])["name"][0]
    assert one("abcdefghijklmnopqrstuvwxyz", "zyxzyxzyxzyxzyxzyxzyx") < 0.3  # lengths more than 4 apart are no 9 edits
    assert one("abelur", "ablur") > 0.8 and one("", "abelur") == 0
    words = ["", "a", "ab", "ba", "abelur", "ableur", "bodekin" * 9]
    pairs = [(x, y) for x in words for y in words]
    got = dict(zip(pairs, linkage._distances([x for x, _ in pairs], [y for _, y in pairs])))
    assert got["ab", "ba"] == 1 and got["abelur", "ableur"] == 1 and got["", "abelur"] == 6 and got["a", "ab"] == 1 and got["bodekin" * 9, "ab"] >= 61


def test_no_pair_with_support_is_left_out_near():
    rng = np.random.default_rng(1)
    name = lambda: "".join(rng.choice(list("abkoué c"), rng.integers(1, 9))).strip()
    core = [name() for _ in range(300)]
    kinds = [["cafe"] * int(rng.integers(2)) for _ in core]
    joined = [c.replace(" ", "") + "".join(k) for c, k in zip(core, kinds)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    o = linkage._outlines(pd.Series(core), pd.Series(joined))
    side = lambda at, src: {c: o[c].to_numpy()[at] for c in linkage.OUTLINE} | {"kinded": np.array([bool(k) for k in kinds])[at], "src": np.full(len(at), src), **{k: np.zeros(len(at), dtype=t) for k, t in (("hint", bool), ("twinned", bool), ("addr", int), ("tel", int))}}
    metres = rng.uniform(0, 250, len(i))
    kept = linkage._may_match(side(i, 1), side(j, 2), metres)
    like = linkage._compare_names(*[pd.Series([v[k] for k in at]) for v in (core, kinds, joined) for at in (i, j)])["name"].to_numpy()
    support = np.clip((like - 0.55) / 0.3, 0, 1) * np.clip((linkage.REACH_M - metres) / 90.0, 0, 1)
    assert (support > linkage.LEAST_SUPPORT).sum() > 100 and not (~kept & (support > linkage.LEAST_SUPPORT)).any() and kept.mean() < 0.6


def test_parts_solved_apart_have_the_same_minimum(spark):
    rows = [(n, f"h{n}", f"r{n % 3}", True, "hint", "osm", 4.0, 1.0 - 0.1 * (n % 4), 0.8, 0.0) for n in range(6)] + [(10, "r0", "s0", False, "osm", "google", 4.0, 0.9, 5.8, 0.0), (11, "r0", "s1", False, "osm", "google", 6.0, 1.0, 0.8, 0.0), (12, "h0", "s1", True, "hint", "google", 4.0, 1.0, 0.8, 0.0)]
    cand = spark.createDataFrame(rows, "var long, a string, b string, hint boolean, source_a string, source_b string, up double, up_to double, down double, down_from double")
    tasks = {r["var"]: r["value"] for r in linkage.solve(cand, merged=1).collect()}
    frames = {r["var"]: r["value"] for r in linkage.admm(cand.select("var", "up", "up_to", "down", "down_from"), linkage._rules(cand), most_rounds=100, tolerance=1e-3).collect()}
    assert tasks.keys() == frames.keys() and all(abs(tasks[v] - frames[v]) < 0.02 for v in tasks) and len({round(v, 1) for v in tasks.values()}) > 2
    parts = linkage.with_parts(cand.selectExpr("xxhash64(a) as x", "xxhash64(b) as y", "a"), merged=1)
    assert parts.select("part").distinct().count() == 3 and {r["var"] for r in linkage.solve(cand, together=2).collect()} == tasks.keys()


# --- models ------------------------------------------------------------------------------------------------------------
def test_network_in_onnxruntime_equals_numpy():
    m = CharTagger(5, hidden=6, seed=2)
    ids, sizes = np.random.default_rng(0).integers(1, 137, size=(7, 40)).astype(np.uint8), np.array([40, 1, 3, 17, 40, 9, 2])
    want = m.emissions(ids, sizes)
    m.compile()
    live = np.arange(40)[None] < sizes[:, None]
    assert m.graph is None or np.abs(m.emissions(ids, sizes) - want)[live].max() < 1e-5


def test_decoding_leaves_out_only_texts_without_labels():
    m = CharTagger(3, hidden=4, seed=5)
    r = np.random.default_rng(1)
    m.p["trans"] = r.normal(size=(3, 3)).astype(np.float32)
    at = np.arange(0, 601, 3)
    scores = r.normal(size=(600, 3)).astype(np.float32) * 3
    scores[::2, 0] += 6
    for got, a in zip(m._viterbi(scores, at, 64), at):
        best = max(itertools.product(range(3), repeat=3), key=lambda p: m.p["start"][p[0]] + sum(scores[a + i, x] for i, x in enumerate(p)) + m.p["trans"][p[0], p[1]] + m.p["trans"][p[1], p[2]])
        assert tuple(got) == best


def test_models_are_fitted_once_a_table(spark):
    fits = []
    fit = lambda: fits.append(1) or np.arange(3)
    key = str(random.random())
    for table, sample in ((key, ["a", None]), (key, ["a", None]), (key, ["a"]), (key + "x", ["a", None])):
        assert models.stored(spark, table, "test", (1,), sample, fit).tolist() == [0, 1, 2]
    assert len(fits) == 3


def test_ordinary_words_of_all_rows(spark):
    df = spark.createDataFrame([(f"Warm soup {i}",) for i in range(6)] + [(None,), ("Keldra Soup",)], "t string")
    assert pii.ordinary_words(df, "t") == {"soup"}
    assert pii.ordinary_words(df.limit(0), "t") == set()


def test_token_counts(spark):
    df = spark.createDataFrame([("a", "The soup was warm"), ("b", None), ("c", ""), ("d", "x" * 20000), ("e", "<|endoftext|>")], "id string, text string")
    got = {r["id"]: r["tokens"] for r in token_counts(df, "id", "text", []).collect()}
    assert got["a"] == 4 and got["b"] == got["c"] == 0 and got["d"] > 100 and got["e"] > 1
