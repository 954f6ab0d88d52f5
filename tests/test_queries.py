"""Every query outside the subpackage llm, beside its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from verify import compare

CORE = {k: f for m in entry.MODULES if ".llm" not in m for k, f in __import__(m, fromlist=["QUERIES"]).QUERIES.items()}
SQL = {k: s for m in entry.MODULES if ".llm" not in m for k, s in __import__(m, fromlist=["SQL"]).SQL.items()}


WITHOUT_SQL = {
    "txt5_prices", "txt7_clauses", "txt8_clause_sentiment", "txt13_simhashes", "txt14_hamming", "txt16_name_similarity", "dup2_near_duplicates", "str9_windowed_limits", "str10_budgets", "res1_resolved_places",
    "res2_refusals", "krn6_profiles", "krn10_supported_sentences", "krn14_grounded_titles", "krn17_overall_sentiment", "krn18_review_aspects", "win6_best_clause", "fe7_hues", "ext6_resolved_mentions",
}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, small, name):
    said = compare(spark, small, name, CORE[name], SQL.get(name))
    # what SQL cannot say is named here, and tested on fixtures in the other files
    assert ": ok," in said or name in WITHOUT_SQL and "no SQL" in said and ": 0 rows" not in said, said


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
