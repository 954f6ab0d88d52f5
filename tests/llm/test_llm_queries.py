"""Queries of the subpackage llm on the smallest tables: beside their SQL, or, where SQL cannot say it, by what must hold of them."""

import pytest

from tastegrid.llm.queries import QUERIES, SQL
from tastegrid.sources.tables import table
from verify import compare

KINDS = {"email", "phone", "id_number", "address", "name"}
LANGUAGES = {"en", "hi", "hi-Latn", "bn", "bn-Latn", "es", "fr", "de"}


def ids(spark, d, name, key):
    return {r[key] for r in table(spark, d, name).select(key).collect()}


def distinct(rows):
    assert len({tuple(r) for r in rows}) == len(rows)


def p3_found(spark, d, rows):
    distinct(rows)
    assert rows and {r["field_name"] for r in rows} <= {"text", "author"} and {r["pii_kind"] for r in rows} <= KINDS
    assert {r["raw_id"] for r in rows} <= ids(spark, d, "raw_reviews", "raw_id")


def p3_redacted(spark, d, rows):
    was = {r["raw_id"]: r for r in table(spark, d, "raw_reviews").collect()}
    assert len(rows) == len(was) and {r["raw_id"] for r in rows} == set(was)
    hidden = 0
    for r in rows:
        text = was[r["raw_id"]]["text"]
        if r["text"] is None or "[" not in r["text"] and "[" not in (text or ""):
            assert r["text"] == text  # nothing found, nothing changed
        elif text and "@" in text and "[EMAIL]" in r["text"]:
            hidden += 1
            assert "@mail." not in r["text"]
    assert hidden > 0


def p4_found(spark, d, rows):
    distinct(rows)
    assert {r["raw_id"] for r in rows} <= ids(spark, d, "raw_reviews", "raw_id")


def p4_scores(spark, d, rows):
    text = {r["raw_id"]: r["text"] or "" for r in table(spark, d, "raw_reviews").collect()}
    assert len(rows) == len(text)
    assert all(0 <= r["score"] <= 1 and 0 <= r["start"] <= r["stop"] <= len(text[r["raw_id"]]) for r in rows)


def p4_source_rates(spark, d, rows):
    assert sum(r["reviews"] for r in rows) == table(spark, d, "raw_reviews").count() and all(0 <= r["unsafe_rate"] <= 1 for r in rows)


def p6_found(spark, d, rows):
    distinct(rows)
    assert rows and {r["language"] for r in rows} <= LANGUAGES


def p6_segments(spark, d, rows):
    text = {r["raw_id"]: r["text"] for r in table(spark, d, "raw_reviews").collect()}
    at = {}
    for r in rows:
        assert 0 < r["confidence"] <= 1 and 0 <= r["start"] < r["stop"] <= len(text[r["raw_id"]])
        at.setdefault(r["raw_id"], []).append((r["start"], r["stop"]))
    for raw_id, spans in at.items():  # the segments of a text cover it once, end to end
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len(text[raw_id]) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def p7_found(spark, d, rows):
    distinct(rows)
    assert rows and all(r["id_a"] < r["id_b"] and r["id_a"].startswith("pl-") for r in rows)
    source = {r["place_id"]: r["source"] for r in table(spark, d, "raw_places").collect()}
    assert all(source[r["id_a"]] != source[r["id_b"]] for r in rows if r["id_b"].startswith("pl-"))


def p7_matches(spark, d, rows):
    assert rows and all(0.5 < r["confidence"] <= 1 for r in rows)


def p8_packed(spark, d, rows):
    room = {r["container_kind"]: r["capacity_tokens"] for r in table(spark, d, "containers").collect()}
    boxes, parts = {}, {}
    for r in rows:
        box = (r["container_kind"], r["container_id"])
        boxes[box] = boxes.get(box, 0) + r["tokens"]
        parts.setdefault((r["container_kind"], r["doc_id"]), []).append(r["part"])
    assert all(n <= room[kind] for (kind, _), n in boxes.items())
    assert all(sorted(p) == list(range(len(p))) for p in parts.values())  # every piece once
    per = {kind: sum(r["tokens"] for r in rows if r["container_kind"] == kind) for kind in room}
    assert len(set(per.values())) == 1  # each kind holds all tokens


def p8_fill_rates(spark, d, rows):
    assert len(rows) == 3 and all(0.9 < r["fill"] <= 1 for r in rows)


def p9_mix(spark, d, rows):
    most = {r["source"]: r["max_repeats"] for r in table(spark, d, "mix_targets").collect()}
    assert rows and len({r["doc_id"] for r in rows}) == len(rows) and all(1 <= r["repeats"] <= most[r["source"]] for r in rows)


def p9_shares(spark, d, rows):
    assert abs(sum(r["share"] for r in rows) - 1) < 1e-9 and all((r["most_repeats"] or 0) <= r["max_repeats"] for r in rows)


def p10_found(spark, d, rows):
    distinct(rows)
    assert rows and {r["doc_id"] for r in rows} <= ids(spark, d, "documents", "doc_id")


def p10_at_limits(spark, d, rows):
    found = {r["doc_id"] for r in QUERIES["p10_found"](spark, d).collect()}
    assert {r["doc_id"] for r in rows} <= found


def p10_source_rates(spark, d, rows):
    assert sum(r["texts"] for r in rows) == table(spark, d, "documents").count() and all(r["at_fixed_length"] <= r["truncated"] <= r["texts"] for r in rows)


HOLDS = {k: f for k, f in globals().items() if k in QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    if name in SQL:
        said = compare(spark, small, name, QUERIES[name], SQL[name])
        assert ": ok," in said, said
    else:
        HOLDS[name](spark, small, QUERIES[name](spark, small).collect())
