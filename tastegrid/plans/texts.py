"""Queries of text functions, duplicates, dictionary matches and lookups, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.functions import text as T
from tastegrid.operators import mentions as M
from tastegrid.sources.tables import table

QUERIES_ASKED = ["rice biryani", "prawn rol", "chiken momo", "yoghurt", "crab soup", "banana flower", "lentil", "blue", "cafe"]


def _reviews(spark, d):
    return table(spark, d, "raw_reviews")


def _fingerprint():
    """Of what was written, by whom and when: text, author and time of publication."""
    return T.content_hash(T.normalize_name(T.clean_text("text")), T.normalize_name("author"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


def txt1_clean_text(spark, d):
    return _reviews(spark, d).select("raw_id", T.clean_text("text").alias("clean"))


def txt2_normalized_names(spark, d):
    return table(spark, d, "raw_places").select("place_id", T.normalize_name("name").alias("normal"))


def txt3_slugs(spark, d):
    return table(spark, d, "restaurants").select("id", T.slugify("name").alias("slug"))


def txt4_content_hashes(spark, d):
    return _reviews(spark, d).select("raw_id", _fingerprint().alias("hash"))


def txt5_prices(spark, d):
    return _reviews(spark, d).select("raw_id", F.explode(T.extract_prices("text")).alias("price"))


def txt6_tokens(spark, d):
    return _reviews(spark, d).select("raw_id", F.size(T.tokens("text")).alias("tokens"), F.size(T.token_set("text")).alias("distinct_tokens"))


def txt7_clauses(spark, d):
    return _reviews(spark, d).select("raw_id", F.posexplode(T.split_clauses("text")).alias("at", "clause"))


def txt8_clause_sentiment(spark, d):
    c = T.with_clause_sentiment(txt7_clauses(spark, d), "clause")
    return c.select("raw_id", "at", F.round("sentiment", 4).alias("sentiment"), F.round("confidence", 2).alias("confidence"))


def txt9_attributes(spark, d):
    # the normalised text is a column of its own, so that it isn't computed for each word
    return _reviews(spark, d).select("raw_id", T.normalize_name("text").alias("n")).select("raw_id", F.explode(T.attributes_in("n")).alias("attribute"))


def txt11_scripts(spark, d):
    share = lambda block: F.length(F.regexp_replace("text", f"[^{block}]", "")) / F.nullif(F.length(F.regexp_replace("text", r"[^\p{L}\p{M}]", "")), F.lit(0))
    return _reviews(spark, d).select("raw_id", F.when(share("ঀ-৿") > 0.2, "bengali").when(share("ऀ-ॿ") > 0.2, "devanagari").otherwise("other").alias("script"))


def txt12_spam(spark, d):
    return _reviews(spark, d).select("raw_id", "text", T.tokens("text").alias("words")).select("raw_id", T.spam_score("text", words="words").alias("spam"))


def txt13_simhashes(spark, d):
    return _reviews(spark, d).select("raw_id", T.simhash("text").alias("simhash"))


def txt15_title_overlap(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.round(T.jaccard(T.token_set("title"), T.token_set("text")), 6).alias("overlap"))


def txt18_full_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(T.matches_all(F.lit("Cold prawn"), F.col("text"))).select("doc_id")


def _asked(spark):
    return spark.createDataFrame([(q,) for q in QUERIES_ASKED], "query string")


def qry2_dish_lookup(spark, d):
    names = table(spark, d, "dishes").select("id", "name").where("name is not null")
    return M.lookup_by_trigrams(_asked(spark), names, 0.45)


def qry4_suggestions(spark, d):
    dishes = table(spark, d, "dishes").select("id", "name").where("name is not null")
    places = table(spark, d, "restaurants").select("id", "name").where("name is not null")
    return M.prefix_or_similar(_asked(spark), dishes.unionByName(places))


def ext2_dish_mentions(spark, d):
    entries = table(spark, d, "dishes").where("name is not null").select(T.normalize_name("name").alias("alias"), F.col("id").alias("key"))
    return M.dictionary_matches(_reviews(spark, d), "raw_id", "text", entries).select("raw_id", F.col("key").alias("dish_id"), "at")


def res4_named_places(spark, d):
    entries = table(spark, d, "restaurants").where("name is not null").select(T.normalize_name("name").alias("alias"), F.col("id").alias("key"))
    hints = _reviews(spark, d).where("restaurant_hint is not null")
    return M.single_mentions(M.dictionary_matches(hints, "raw_id", "restaurant_hint", entries), "raw_id").select("raw_id", F.col("key").alias("restaurant_id"), "label")


def dup1_exact_duplicates(spark, d):
    return M.exact_duplicates(_reviews(spark, d), "raw_id", _fingerprint())


def dup2_near_duplicates(spark, d):
    solved = table(spark, d, "review_analysis").where("restaurant_id is not null").groupBy("raw_id").agg(F.min("restaurant_id").alias("restaurant_id"))
    return M.near_duplicates(_reviews(spark, d).join(solved, "raw_id"), "restaurant_id", "raw_id", "text", "ingested_at")


_FNS = [
    txt1_clean_text, txt2_normalized_names, txt3_slugs, txt4_content_hashes, txt5_prices, txt6_tokens, txt7_clauses, txt8_clause_sentiment, txt9_attributes, txt11_scripts, txt12_spam, txt13_simhashes,
    txt15_title_overlap, txt18_full_text, qry2_dish_lookup, qry4_suggestions, ext2_dish_mentions, res4_named_places, dup1_exact_duplicates, dup2_near_duplicates,
]
QUERIES = {f.__name__: f for f in _FNS}


# half and full width forms, as text, and what else of the compatibility characters the tables hold
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def clean_sql(c: str) -> str:
    c = f"nfc_normalize(translate(replace(replace(coalesce({c}, ''), '…', '...'), chr(160), ' '), '{_WIDE}', '{_NARROW}'))"
    c = f"regexp_replace({c}, '[\\x{{200b}}-\\x{{200f}}\\x{{feff}}\\x{{2060}}]', '', 'g')"
    c = f"regexp_replace({c}, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g')"
    c = f"regexp_replace({c}, '[*_~`>#\\[\\]()]', ' ', 'g')"
    return f"substr(trim(regexp_replace({c}, '\\s+', ' ', 'g')), 1, 8000)"


def normal_sql(c: str) -> str:
    """DuckDB's own removal of accents; signs of vowels, which it would drop too, become blanks before."""
    signs = "[\\x{0900}-\\x{0903}\\x{093a}\\x{093b}\\x{093e}-\\x{094c}\\x{094e}\\x{094f}\\x{0962}\\x{0963}\\x{0981}-\\x{0983}\\x{09be}-\\x{09cc}\\x{09d7}\\x{09e2}\\x{09e3}]"
    c = f"strip_accents(regexp_replace(translate(replace(coalesce({c}, ''), '…', ' '), '{_WIDE}', '{_NARROW}'), '{signs}', ' ', 'g'))"
    c = f"replace(lower({c}), '&', ' and ')"
    c = f"trim(regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for ending in ("pvt ltd", "private limited", "llp", "restaurant and bar", "family restaurant"):
        c = f"trim(regexp_replace({c}, '{ending}$', ''))"
    return c


def tokens_sql(c: str) -> str:
    return f"list_filter(string_split({normal_sql(c)}, ' '), lambda t: t <> '')"


def slug_sql(c: str) -> str:
    return f"coalesce(nullif(substr(trim(regexp_replace(replace({normal_sql(c)}, ' ', '-'), '-{{2,}}', '-', 'g'), '-'), 1, 120), ''), 'item')"


def trigrams_sql(c: str) -> str:
    return f"list_distinct(flatten(list_transform({tokens_sql(c)}, lambda w: list_transform(range(1, cast(len(w) + 2 as bigint)), lambda i: substr('  ' || w || ' ', i, 3)))))"


_HASH = f"sha256({normal_sql(clean_sql('text'))} || case when author is null then '|' else '|' || {normal_sql('author')} end || case when published_at is null then '' else '|' || strftime(published_at, '%Y-%m-%d %H:%M:%S') end)"
_HITS = lambda marks: "(" + " + ".join(f"cast(contains(low, '{m}') as int)" for m in marks) + ")"
_ASKED = "asked as (select unnest([" + ", ".join(f"'{q}'" for q in QUERIES_ASKED) + "]) as query)"
_SIM = "round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 4)"


def _near_sql(names: str, least: float, prefix: bool) -> str:
    begins = " or starts_with(nn, qn)" if prefix else ""
    return f"""with {_ASKED}, q as (select query, {normal_sql('query')} as qn, {trigrams_sql('query')} as qt from asked), n as (select id, name, {normal_sql('name')} as nn, {trigrams_sql('name')} as nt from ({names}) where name is not null),
      p as (select query, id, name, nn, qn, {_SIM.format(a='qt', b='nt')} as similarity from q cross join n) select query, id, name, similarity from p where similarity > {least}{begins}"""


def _mentions_sql(source: str, text: str, entries: str) -> str:
    """Matches (raw_id, key, alias, pos) of entries in a text, longest first, by n-grams."""
    return f"""e as (select {normal_sql('name')} as alias, id as key from {entries} where name is not null),
      t as (select raw_id, {tokens_sql(text)} as ts from {source}),
      g as (select raw_id, n, pos, array_to_string(ts[pos:pos + n - 1], ' ') as gram from (select raw_id, ts, n, unnest(range(1, len(ts) - n + 2)) as pos from (select raw_id, ts, unnest(range(1, least(5, len(ts)) + 1)) as n from t where len(ts) > 0))),
      f as (select raw_id, alias, n, min(pos) as pos from g join (select distinct alias from e where alias <> '') on gram = alias group by all),
      m as (select raw_id, alias, key, pos from (select * from f a where not exists (select 1 from f b where b.raw_id = a.raw_id and b.n > a.n and b.pos <= a.pos and b.pos + b.n >= a.pos + a.n)) join e using (alias))"""


SQL = {
    "txt1_clean_text": f"select raw_id, {clean_sql('text')} as clean from raw_reviews",
    "txt2_normalized_names": f"select place_id, {normal_sql('name')} as normal from raw_places",
    "txt3_slugs": f"select id, {slug_sql('name')} as slug from restaurants",
    "txt4_content_hashes": f"select raw_id, {_HASH} as hash from raw_reviews",
    "txt6_tokens": f"select raw_id, cast(len({tokens_sql('text')}) as int) as tokens, cast(len(list_distinct({tokens_sql('text')})) as int) as distinct_tokens from raw_reviews",
    "txt9_attributes": "select raw_id, attribute from (select raw_id, unnest(list_filter([" + ", ".join("case when " + " or ".join(f"contains(low, '{w}')" for w in ws) + f" then '{n}' end" for n, ws in T.ATTRIBUTES.items()) + f"], lambda x: x is not null)) as attribute from (select raw_id, {normal_sql('text')} as low from raw_reviews))",
    "txt11_scripts": """with c as (select raw_id, len(regexp_replace(text, '[^\\x{0980}-\\x{09ff}]', '', 'g')) as b, len(regexp_replace(text, '[^\\x{0900}-\\x{097f}]', '', 'g')) as h, nullif(len(regexp_replace(text, '[^\\p{L}\\p{M}]', '', 'g')), 0) as n from raw_reviews)
      select raw_id, case when b / n > 0.2 then 'bengali' when h / n > 0.2 then 'devanagari' else 'other' end as script from c""",
    "txt12_spam": f"""with c as (select raw_id, trim(coalesce(text, '')) as body, lower(trim(coalesce(text, ''))) as low, {tokens_sql('text')} as ts, len(regexp_replace(trim(coalesce(text, '')), '\\P{{L}}', '', 'g')) as letters, len(regexp_replace(trim(coalesce(text, '')), '\\P{{Lu}}', '', 'g')) as capitals from raw_reviews)
      select raw_id, case when body = '' then 1.0::double else round(least(1.0::double, case when len(ts) < 4 then 0.35::double else 0 end + case when len(ts) = 0 then 0 when len(list_distinct(ts)) / len(ts) < 0.3 then 0.45::double when len(list_distinct(ts)) / len(ts) < 0.5 then 0.25::double else 0 end
        + least(0.4::double, {_HITS(T.CONTACT)} * 0.2::double) + least(0.45::double, {_HITS(T.PROMO)} * 0.18::double) + case when letters >= 12 and capitals / letters > 0.7 then 0.15::double else 0 end
        + case when regexp_matches(low, '{"|".join(c * 5 for c in "abcdefghijklmnopqrstuvwxyz")}') then 0.15::double else 0 end), 4) end as spam from c""",
    "txt15_title_overlap": f"""with c as (select doc_id, list_distinct({tokens_sql('title')}) as a, list_distinct({tokens_sql('text')}) as b from documents)
      select doc_id, round(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as overlap from c""",
    "txt18_full_text": f"select doc_id from documents where list_has_all({tokens_sql('text')}, ['cold', 'prawn'])",
    "qry2_dish_lookup": _near_sql("select id, name from dishes", 0.45, False),
    "qry4_suggestions": _near_sql("select id, name from dishes union all select id, name from restaurants", 0.3, True),
    "ext2_dish_mentions": f"with {_mentions_sql('raw_reviews', 'text', 'dishes')} select raw_id, key as dish_id, cast(pos as int) as \"at\" from m",
    "res4_named_places": f"with {_mentions_sql('(select raw_id, restaurant_hint from raw_reviews where restaurant_hint is not null)', 'restaurant_hint', 'restaurants')} select raw_id, min(key) as restaurant_id, min(alias) as label from m group by raw_id having count(distinct key) = 1",
    "dup1_exact_duplicates": f"with h as (select raw_id, {_HASH} as h from raw_reviews), f as (select h, min(raw_id) as first_id from h group by h having count(*) > 1) select raw_id, first_id from h join f using (h) where raw_id <> first_id",
}
