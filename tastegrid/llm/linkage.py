"""Matching records of different sources without shared keys, as soft logic.

Candidates share a neighbourhood (latitude-strip sweep), or, where coordinates are missing, a name as it sounds but for a
letter, or an address or phone with a name that is alike. Each candidate pair is a variable between 0 and 1 under weighted hinge-loss rules:

    similar name & near, or same address, or same phone  =>  match
    different kind of business, address or phone; without evidence  =>  no match
    a record matches at most one record of another source
    match(a, b) & match(b, c)  =>  match(a, c)

The sum of the hinges is convex. It is minimised by consensus ADMM: rules project their copies of the variables, variables
average their copies. Candidates that hang together are one problem, solved in a task; one too large for that is solved in
DataFrames (windows over rules, aggregates over variables; the state is written to the shared folder every round). The value
of a variable is the confidence of its match.

Defined results: records without a name match nothing; coordinates that are null, NaN, both 0 or impossible count as
missing, swapped ones are turned round if that alone puts them near a known city; repeated fetches of one (source,
external_id) are one record and share its matches; empty tables give no matches.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegrid.operators.geo_near import _blocks, near_positions, points_in_regions
from tastegrid.session import discard, parallelism
from tastegrid.session import settle as _settle

REACH_M = 250.0
COMMON_SHARE, COMMON_LEAST = 0.0045, 5
LEAST_SUPPORT = 0.1
#: letters and length of the core and the joined name, as written and as they sound
OUTLINE = ["c", "cn", "cs", "csn", "j", "jn", "js", "jsn"]
#: candidate pairs that hang together and are solved in one task; more of them are solved in DataFrames. Edges a single task merges.
TOGETHER, MERGED = 50_000, 400_000

# fixed values: spellings of common words, and words that names carry or drop at will
SPELLINGS = {
    "cnr": "corner", "pt": "point", "center": "centre", "ctr": "centre", "hse": "house", "kitchn": "kitchen", "resto": "restaurant", "rd": "road", "ln": "lane", "st": "street", "ave": "avenue",
}
LEGAL = {"pvt", "ltd", "llp", "co", "inc", "llc", "limited", "private", "company", "the", "and", "restaurant"}


def _tokens(name: str) -> list[str]:
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    s = re.split(r"\s[-–—@|]\s|\s?[,(|]\s?|\s?@", s.strip())[0]
    return [SPELLINGS.get(t, t) for t in re.findall(r"[^\W_]+", s.replace("'", ""))]


def _name_tokens(s: pd.Series) -> pd.Series:
    """Words of a name in plain letters, without what follows a dash, comma or bracket and without legal forms."""
    return s.map(lambda n: [t for t in _tokens(n) if t not in LEGAL] if isinstance(n, str) else None)


def _address_key(s: pd.Series) -> pd.Series:
    """House number and street; null without both."""

    def key(a):
        if not isinstance(a, str):
            return None
        ts = [SPELLINGS.get(t, t) for t in re.findall(r"[^\W_]+", a.lower().split(",")[0])]
        num = [t for t in ts if t[0].isdigit()]
        return f"{num[0]} {' '.join(t for t in ts if not t[0].isdigit())}" if num and len(num) < len(ts) else None

    return s.map(key)


def _distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edits with swaps of neighbours (restricted) of each pair; pairs of like length are worked out at once."""
    out, long = np.zeros(len(a), dtype=int), np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=int)
    order, at = np.argsort(long, kind="stable"), 0
    while at < len(order):
        side = max(8, int(long[order[at]]) + 2)
        some = order[at : at + max(1, 4_000_000 // (side + 1) ** 2)]
        some = some[long[some] <= side]
        at += len(some)
        x, y = (np.array([s[k] for k in some], dtype=f"U{side}").view(np.uint32).reshape(len(some), side).T for s in (a, b))
        la, lb = (np.array([len(s[k]) for k in some]) for s in (a, b))
        d = np.zeros((la.max() + 1, lb.max() + 1, len(some)), dtype=np.int16)
        d[:, 0], d[0] = np.arange(d.shape[0])[:, None], np.arange(d.shape[1])[:, None]
        for i in range(1, d.shape[0]):
            for j in range(1, d.shape[1]):
                v = np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]) + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1:
                    v = np.where((x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1]), np.minimum(v, d[i - 2, j - 2] + 1), v)
                d[i, j] = v
        out[some] = d[la, lb, np.arange(len(some))]
    return out


def _likenesses(pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Of each pair of spellings: 1 less the share of letters that differ, as written or (a little less) as it sounds."""
    sound = {w: _sound(w) for w in {w for p in pairs for w in p}}
    spelt = [p for p in set(pairs) if p[0] and p[1]]
    heard = [(sound[x], sound[y]) for x, y in spelt]
    todo = list({*spelt, *heard})
    apart = dict(zip(todo, _distances([x for x, _ in todo], [y for _, y in todo])))
    share = lambda p: 1.0 - apart[p] / max(len(p[0]), len(p[1]), 1)
    return {p: max(0.0, share(p), 0.97 * share(h)) for p, h in zip(spelt, heard)}


def _sound(w: str) -> str:
    """Spellings that sound alike become one."""
    for x, y in (("oo", "u"), ("ee", "i"), ("ck", "k"), ("ph", "f"), ("c", "k"), ("q", "k"), ("w", "v"), ("b", "v")):
        w = w.replace(x, y)
    return re.sub(r"(.)\1+", r"\1", w)


def _compare_names(core_a: pd.Series, core_b: pd.Series, rest_a: pd.Series, rest_b: pd.Series, all_a: pd.Series, all_b: pd.Series) -> pd.DataFrame:
    """Likeness of the rare parts of two names (0..1), and how far their common words contradict each other (0..1)."""
    out, rows = [], [(ca, cb, ra, rb, ja, jb, not (len(ra) and len(rb))) for ca, cb, ra, rb, ja, jb in zip(core_a, core_b, rest_a, rest_b, all_a, all_b)]
    likeness = _likenesses([(r[0], r[1]) for r in rows] + [(r[4], r[5]) for r in rows if r[6]])
    for ca, cb, ra, rb, ja, jb, whole in rows:
        like = max(likeness.get((ca, cb), 0.0), likeness.get((ja, jb), 0.0) if whole else 0.0)
        sa, sb = set(ra), set(rb)
        against = 0.0
        if sa and sb and ja != jb:
            common = len(sa & sb)
            against = 0.0 if sa <= sb or sb <= sa else (1.0 - common / min(len(sa), len(sb)) if common == 0 else 0.7)
        out.append((like, against))
    return pd.DataFrame(out, columns=["name", "kind"])


def chain_names(recs: DataFrame) -> DataFrame:
    """(core, kinds) of chains: a core in 4 or more cells of 5 km, mostly (in half of all its cells at least) with the same kind
    of business. In a larger table a core comes in any number of cells by chance, but then for different kinds."""
    cell = F.when(F.col("lat").isNotNull(), F.struct(F.round(F.col("lat") * 20).alias("y"), F.round(F.col("lng") * 20).alias("x")))
    per = recs.select("core", F.array_sort(F.array_distinct("kinds")).alias("sort"), "kinds", cell.alias("cell")).where("cell is not null")
    of = lambda *keys: per.groupBy(*keys).agg(F.countDistinct("cell").alias("cells"))
    alike = of("core", "sort").where("cells >= 4").join(of("core").select("core", F.col("cells").alias("all")), "core").where("cells * 2 >= all")
    return per.join(alike, ["core", "sort"], "left_semi").select("core", "kinds").distinct()


def _letters(w: str) -> int:
    """Bits for a letter that comes, and comes again, in 32 classes of letters: what two words differ by in them, they are apart by edits at least."""
    bits = 0
    for c in w:
        one = 1 << 2 * (ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 6)
        bits |= one << 1 if bits & one else one
    return bits - (1 << 64) if bits >> 63 else bits


def _outlines(core: pd.Series, joined: pd.Series) -> pd.DataFrame:
    out = []
    for pair in zip(core, joined):
        out.append([x for w in pair for v in (w, _sound(w)) for x in (_letters(v), len(v))])
    return pd.DataFrame(out, columns=OUTLINE)


def _may_match(x: dict, y: dict, metres: np.ndarray) -> np.ndarray:
    """Which pairs in reach can have support at all: of different sources, or a hint and a record; and the same address or
    phone, or names whose letters don't rule out that they are alike enough at this distance."""
    other = np.where(x["hint"] | y["hint"], x["hint"] != y["hint"], (x["src"] != y["src"]) & (x["src"] != 0) & (y["src"] != 0))
    most = np.zeros(len(metres))
    for k, factor in (("c", 1.0), ("cs", 0.97), ("j", 1.0), ("js", 0.97)):
        p, q, n, m = x[k].astype(np.uint64), y[k].astype(np.uint64), x[k + "n"], y[k + "n"]
        edits = np.maximum(np.maximum(np.bitwise_count(p & ~q), np.bitwise_count(q & ~p)).astype(int), np.abs(n - m))
        like = factor * (1.0 - edits / np.maximum(np.maximum(n, m), 1))
        most = np.maximum(most, like if k[0] == "c" else np.where(x["kinded"] & y["kinded"], 0.0, like))
    same = lambda k: (x[k] == y[k]) & (x[k] != 0)
    support = np.clip((most - 0.55) / 0.3, 0, 1) * np.clip((REACH_M - metres) / 90.0, 0, 1)
    return other & ((support > LEAST_SUPPORT - 1e-9) | same("addr") | same("tel") | ((x["hint"] | y["hint"]) & (x["twinned"] | y["twinned"])))


def _sounds(s: pd.Series) -> pd.Series:
    return s.map(lambda w: _sound(w.replace(" ", "")) if isinstance(w, str) else None)


# built when asked for: the workers import this module without a session
def name_tokens(col) -> Column:
    return F.pandas_udf(_name_tokens, "array<string>")(col)


def address_key(col) -> Column:
    return F.pandas_udf(_address_key, "string")(col)


def compare_names(*cols) -> Column:
    # not deterministic to Spark, so that filters on the result don't run it a second time
    return F.pandas_udf(_compare_names, "struct<name:double,kind:double>").asNondeterministic()(*cols)


def outlines(*cols) -> Column:
    return F.pandas_udf(_outlines, "struct<" + ",".join(f"{c}:bigint" for c in OUTLINE) + ">")(*cols)


def with_names(df: DataFrame, name: str, common: DataFrame, firsts: DataFrame) -> DataFrame:
    """Adds core (rare words), sound (core as it sounds), kinds (common words but epithets), lead (epithets), joined. common: one row, array `words`."""
    df = df.withColumn("tokens", name_tokens(name)).crossJoin(F.broadcast(common)).crossJoin(F.broadcast(firsts))  # one row each, at most 1 / COMMON_SHARE words
    core = F.array_join(F.filter("tokens", lambda t: ~F.array_contains("words", t)), " ")
    kinds = F.filter("tokens", lambda t: F.array_contains("words", t) & ~F.array_contains("epithets", t))
    lead = F.filter("tokens", lambda t: F.array_contains("epithets", t))
    df = df.withColumn("core", F.when(F.length(core) > 0, core).otherwise(F.array_join("tokens", " ")))
    df = df.withColumn("sound", F.pandas_udf(_sounds, "string")("core"))
    return df.withColumns({"kinds": kinds, "lead": lead, "joined": F.array_join("tokens", "")}).drop("words", "epithets", "tokens")


def common_words(records: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Words in more than COMMON_SHARE of the names (hence a bounded list), and those of them that mostly come first."""
    words = records.select(F.posexplode(F.array_distinct(name_tokens(name))).alias("at", "t"))
    total = records.agg(F.count(name).alias("n"))
    per = words.groupBy("t").agg(F.count("*").alias("c"), F.avg((F.col("at") == 0).cast("double")).alias("first"))
    per = per.crossJoin(F.broadcast(total)).where((F.col("c") >= F.col("n") * COMMON_SHARE) & (F.col("c") >= COMMON_LEAST))
    return per.agg(F.collect_set("t").alias("words")), per.agg(F.collect_set(F.when(F.col("first") > 0.7, F.col("t"))).alias("epithets"))


def _phone(c: str) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= 8, F.substring(digits, -8, 8))


def place_records(places: DataFrame, cities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, members): one record for each (source, external_id) with its best coordinates; place_id -> record."""
    rid = F.concat_ws("|", F.coalesce("source", F.lit("?")), F.coalesce("external_id", F.col("place_id")))
    rows = places.select("place_id", "source", rid.alias("rid"), "name", "lat", "lng", "address", "phone", "fetched_at")
    ok = F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng") & ~((F.col("lat") == 0) & (F.col("lng") == 0))
    newest = lambda c, when=None: F.max_by(c, F.when(F.col(c).isNotNull() if when is None else when, F.struct("fetched_at", "place_id")))
    recs = rows.groupBy("rid").agg(
        F.first("source").alias("source"), newest("name").alias("name"), newest("lat", ok).alias("lat"), newest("lng", ok).alias("lng"), newest("address").alias("address"), newest("phone").alias("phone")
    )
    as_is = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    turned = F.col("lng").between(-90, 90) & F.col("lat").between(-180, 180)
    both = recs.select("rid", F.col("lat").alias("y"), F.col("lng").alias("x"), as_is.alias("as_is"), turned.alias("turned")).where("y is not null and x is not null")
    ways = both.where("as_is").select(F.concat(F.lit("0"), "rid").alias("w"), F.col("y").alias("lat"), F.col("x").alias("lng")).unionByName(
        both.where("turned").select(F.concat(F.lit("1"), "rid").alias("w"), F.col("x").alias("lat"), F.col("y").alias("lng"))
    )
    wide = cities.select("id", "lat", "lng", (F.col("radius_m") * 1.5).alias("radius_m"))
    inside = points_in_regions(ways, "w", wide, "id").groupBy(F.substring("id", 2, 1000).alias("rid")).agg(
        F.max(F.substring("id", 1, 1) == "0").alias("fits"), F.max(F.substring("id", 1, 1) == "1").alias("fits_turned"), F.collect_set("region_id").alias("cities")
    )
    recs = recs.join(inside, "rid", "left")
    turn = F.coalesce(~F.col("fits") & F.col("fits_turned"), F.lit(False)) | (~as_is & turned)
    recs = recs.withColumns({"lat": F.when(turn, F.col("lng")).otherwise(F.col("lat")), "lng": F.when(turn, F.col("lat")).otherwise(F.col("lng"))})
    bad = ~F.coalesce(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180), F.lit(False))
    recs = recs.withColumns({"lat": F.when(bad, None).otherwise(F.col("lat")), "lng": F.when(bad, None).otherwise(F.col("lng")), "addr": address_key("address"), "tel": _phone("phone")})
    return recs.select("rid", "source", "name", "lat", "lng", "addr", "tel", "cities"), rows.select("place_id", "rid")


def _deletions(c: str) -> Column:
    """The word and all its forms with one letter left out (for words of five letters or more)."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.lit(1000))))
    return F.array_distinct(F.when(F.length(c) >= 5, F.concat(F.array(c), cut)).otherwise(F.array(c)))


def settle(df: DataFrame, name: str) -> DataFrame:
    return _settle(df, name, release=True)


def admm(variables: DataFrame, rules: DataFrame, least_rounds: int = 8, most_rounds: int = 60, tolerance: float = 0.02, rho: float = 1.0, residuals: list | None = None) -> DataFrame:
    """(var, value). variables: var, up, up_to, down, down_from (hinges up*max(0, up_to - z) and down*max(0, z - down_from));
    rules: rule, var, c, w, b, each a hinge w*max(0, sum(c*z) + b) over its rows.

    Rounds go on until the primal residual (root mean square of copies less their variable) and the dual one (of the
    variables' last step, times rho) are at most `tolerance`; if most_rounds do not do, the values are not the minimum and a
    warning says so. `residuals`, a list, takes (round, primal, dual)."""
    z = variables.withColumns({"z": F.col("up_to") * 1.0, "u1": F.lit(0.0), "u2": F.lit(0.0)})
    m = rules.withColumns({"y": F.lit(None).cast("double"), "u": F.lit(0.0)})
    rule, old = W.partitionBy("rule"), []
    for n in range(1, most_rounds + 1):
        m = m.join(z.select("var", "z"), "var")
        m = m.withColumn("u", F.when(F.col("y").isNull(), F.col("u")).otherwise(F.col("u") + F.col("y") - F.col("z")))
        m = m.withColumn("v", F.col("z") - F.col("u"))
        over = (F.sum(F.col("c") * F.col("v")).over(rule) + F.col("b")) / F.sum(F.col("c") * F.col("c")).over(rule)
        m = m.withColumn("y", F.col("v") - F.col("c") * F.greatest(F.lit(0.0), F.least(F.col("w") / rho, over)))
        # each round is written once, so that neither plans nor recomputation grow with the rounds
        m = settle(m.select("rule", "var", "c", "w", "b", "y", "u"), "admm-m")
        sums = m.groupBy("var").agg(F.sum(F.col("y") + F.col("u")).alias("s"), F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
        z = z.join(sums, "var", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("s", "n", "sy", "syy")})
        # projections of the variable's own two hinges
        v1, v2 = F.col("z") - F.col("u1"), F.col("z") - F.col("u2")
        z = z.withColumn("y1", v1 + F.greatest(F.lit(0.0), F.least(F.col("up") / rho, F.col("up_to") - v1)))
        z = z.withColumn("y2", v2 - F.greatest(F.lit(0.0), F.least(F.col("down") / rho, v2 - F.col("down_from"))))
        new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("s") + F.col("y1") + F.col("u1") + F.col("y2") + F.col("u2")) / (F.col("n") + 2)))
        z = z.withColumns({"last": F.col("z"), "z": new})
        apart = F.col("syy") - 2 * F.col("z") * F.col("sy") + F.col("n") * F.col("z") * F.col("z") + F.pow(F.col("y1") - F.col("z"), 2) + F.pow(F.col("y2") - F.col("z"), 2)
        moved = (F.col("n") + 2) * F.pow(F.col("z") - F.col("last"), 2)
        z = z.select("var", "up", "up_to", "down", "down_from", "z", (F.col("u1") + F.col("y1") - F.col("z")).alias("u1"), (F.col("u2") + F.col("y2") - F.col("z")).alias("u2"), apart.alias("apart"), moved.alias("moved"), (F.col("n") + 2).alias("copies"))
        z = settle(z, "admm-z")
        for df in old:  # the round before is read no more
            discard(df)
        old = [m, z]
        if n >= least_rounds:
            r = z.agg(F.sum("apart").alias("p"), F.sum("moved").alias("d"), F.sum("copies").alias("n")).first()
            primal, dual = ((max(0.0, r[c] or 0.0) / max(1, r["n"] or 1)) ** 0.5 for c in ("p", "d"))
            if residuals is not None:
                residuals.append((n, primal, dual * rho))
            if primal <= tolerance and dual * rho <= tolerance:
                break
        z = z.drop("apart", "moved", "copies")
    else:
        warnings.warn(f"no minimum within {most_rounds} rounds: residuals {primal:.3g} and {dual:.3g}", stacklevel=2)
    return z.select("var", F.col("z").alias("value"))


def _rules(cand: DataFrame) -> DataFrame:
    """Rules over several variables: a record has at most one match in each other source; matches are transitive."""
    ends = cand.select("var", F.col("a").alias("r"), F.col("source_b").alias("to")).unionByName(cand.where("not hint").select("var", F.col("b").alias("r"), F.col("source_a").alias("to")))
    one = ends.select(F.xxhash64(F.lit("one"), "r", "to").alias("rule"), "var", F.count("*").over(W.partitionBy("r", "to")).alias("n")).where("n > 1")
    one = one.select("rule", "var", F.lit(1.0).alias("c"), F.lit(8.0).alias("w"), F.lit(-1.0).alias("b"))
    # triangles: each edge points from the end with fewer edges to the one with more, so no end has more than sqrt(2 * edges)
    # edges going out, and each triangle comes once, from the end two of its edges leave
    degree = cand.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    ways = cand.select("var", "a", "b").join(degree.select(F.col("node").alias("a"), F.struct(F.col("d"), F.col("node").alias("r")).alias("x")), "a").join(degree.select(F.col("node").alias("b"), F.struct(F.col("d"), F.col("node").alias("r")).alias("y")), "b")
    ways = settle(ways.select("var", F.least("x", "y").alias("p"), F.greatest("x", "y")["r"].alias("q")).select("var", "p.r", "q"), "ways")
    t = ways.alias("e1").join(ways.alias("e2"), F.expr("e1.r = e2.r and e1.q < e2.q"))
    third = cand.select("var", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    t = t.join(third.alias("e3"), F.expr("e3.lo = e1.q and e3.hi = e2.q"))
    t = t.select(F.col("e1.var").alias("v1"), F.col("e2.var").alias("v2"), F.col("e3.var").alias("v3"))
    sides = F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"v{j}").alias(f"x{j}") for j in (1, 2, 3)]) for i in (1, 2, 3)])
    t = t.select(F.explode(sides).alias("s")).select(F.xxhash64(F.lit("tri"), "s.i", "s.x1", "s.x2", "s.x3").alias("rule"), F.explode(F.array(*[F.struct(F.col(f"s.x{j}").alias("var"), F.when(F.col("s.i") == j, -1.0).otherwise(1.0).alias("c")) for j in (1, 2, 3)])).alias("m"))
    tri = t.select("rule", "m.var", "m.c", F.lit(3.0).alias("w"), F.lit(-1.0).alias("b"))
    return one.unionByName(tri)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, part) of all edges x, y of one task: the parts that hang together, named by a node."""
    up: dict[int, int] = {}

    def top(n: int) -> int:
        while (p := up.setdefault(n, n)) != n:
            up[n] = n = up[p]
        return n

    for df in batches:
        for x, y in zip(df["x"].tolist(), df["y"].tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = np.fromiter(up, dtype=np.int64, count=len(up))
    yield pd.DataFrame({"node": nodes, "part": np.array([top(n) for n in nodes.tolist()], dtype=np.int64)})


def with_parts(edges: DataFrame, merged: int = MERGED) -> DataFrame:
    """Adds part (long), equal for edges (x, y: long) that hang together.

    While there are more than `merged` edges, each node joins the neighbour (or itself) that a hash, another each time, puts
    first, and edges within a group go; the rest are merged in one task."""
    left, steps = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), []
    left = settle(left, "edges")
    while left.count() > merged:
        rank = F.xxhash64(F.lit(len(steps)), "y")
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        step = both.groupBy("x").agg(F.min(F.struct(rank.alias("h"), "y")).alias("m"))
        own = F.xxhash64(F.lit(len(steps)), "x")
        step = settle(step.select(F.col("x").alias("node"), F.when(F.col("m.h") < own, F.col("m.y")).otherwise(F.col("x")).alias("part")), "joined")
        steps.append(step)
        for c in ("x", "y"):
            left = left.join(step.withColumnRenamed("node", c), c).drop(c).withColumnRenamed("part", c)
        left = settle(left.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    steps.append(settle(left.repartition(1).mapInPandas(_merge, "node long, part long"), "merged"))
    out = edges.withColumn("part", F.col("x"))
    for step in steps:
        out = out.join(step.select(F.col("node").alias("part"), F.col("part").alias("to")), "part", "left").withColumn("part", F.coalesce("to", "part")).drop("to")
    return out


def _local_rules(a: np.ndarray, b: np.ndarray, pair: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rules of _rules over edges a - b, as arrays of rows: rule, edge, c, w. pair: both ends are records."""
    n = len(a)
    edge = np.concatenate([np.arange(n), np.flatnonzero(pair)])
    key = pd.DataFrame({"r": np.concatenate([a, b[pair]]), "to": np.concatenate([to_b, to_a[pair]])})
    group = key.groupby(["r", "to"], sort=False).ngroup().to_numpy()
    many = np.bincount(group, minlength=1)[group] > 1
    rule, at, c, w = [group[many]], [edge[many]], [np.ones(many.sum())], [np.full(many.sum(), 8.0)]
    # triangles, each from the end two of its edges leave, as in _rules
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[:n], idx[n:]
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[np.lexsort((np.arange(len(nodes)), np.bincount(idx)))] = np.arange(len(nodes))
    lo, hi = np.minimum(rank[x], rank[y]), np.maximum(rank[x], rank[y])
    order = np.lexsort((hi, lo))
    lo, hi, code = lo[order], hi[order], lo[order] * len(nodes) + hi[order]
    later, rules = np.searchsorted(lo, lo, "right") - np.arange(n) - 1, int(group.max(initial=-1)) + 1
    for some in _blocks(later, 2_000_000):
        i = np.repeat(np.arange(n)[some], later[some])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[some]) - later[some], later[some])
        want = hi[i] * len(nodes) + hi[j]
        third = np.minimum(np.searchsorted(code, want), n - 1)
        ok = code[third] == want
        three = order[np.stack([i[ok], j[ok], third[ok]])]
        for k in range(3):
            rule.append(np.tile(rules + np.arange(three.shape[1]), 3))
            at.append(three.reshape(-1))
            c.append(np.where(np.repeat(np.arange(3), three.shape[1]) == k, -1.0, 1.0))
            w.append(np.full(three.size, 3.0))
            rules += three.shape[1]
    return tuple(map(np.concatenate, (rule, at, c, w)))


def local_admm(own: dict[str, np.ndarray], part: np.ndarray, rule: np.ndarray, at: np.ndarray, c: np.ndarray, w: np.ndarray, b: float = -1.0, tolerance: float = 1e-3, least_rounds: int = 8, most_rounds: int = 20_000) -> np.ndarray:
    """admm() in one task, for parts that share no rule: own has up, up_to, down, down_from; each part ends at its own residuals."""
    n, out = len(part), np.empty(len(part))
    part, rule, kept = np.unique(part, return_inverse=True)[1], np.unique(rule, return_inverse=True)[1], np.arange(n)
    up, up_to, down, down_from = (own[k] for k in ("up", "up_to", "down", "down_from"))
    z, u1, u2, u, y = up_to * 1.0, np.zeros(n), np.zeros(n), np.zeros(len(at)), None
    for k in range(1, most_rounds + 1):
        if y is not None:
            u = u + y - z[at]
        v = z[at] - u
        over = (np.bincount(rule, c * v) + b) / np.bincount(rule, c * c)
        y = v - c * np.maximum(0, np.minimum(w, over[rule]))
        v1, v2 = z - u1, z - u2
        y1, y2 = v1 + np.maximum(0, np.minimum(up, up_to - v1)), v2 - np.maximum(0, np.minimum(down, v2 - down_from))
        copies = np.bincount(at, minlength=len(z)) + 2
        new = np.clip((np.bincount(at, y + u, len(z)) + y1 + u1 + y2 + u2) / copies, 0, 1)
        last, z = z, new
        u1, u2 = u1 + y1 - z, u2 + y2 - z
        if k >= least_rounds and (k < 40 or k % 20 == 0):
            apart = np.bincount(at, (y - z[at]) ** 2, len(z)) + (y1 - z) ** 2 + (y2 - z) ** 2
            all_of = np.maximum(np.bincount(part, copies), 1)
            done = np.maximum(np.bincount(part, apart), np.bincount(part, copies * (z - last) ** 2)) <= tolerance**2 * all_of
            if done.any() or k == most_rounds:
                ends = done[part] if k < most_rounds else np.ones(len(part), dtype=bool)
                out[kept[ends]] = z[ends]
                stay, rows = ~ends, ~ends[at]
                if not stay.any():
                    break
                to = np.cumsum(stay) - 1
                kept, z, u1, u2, up, up_to, down, down_from = (x[stay] for x in (kept, z, u1, u2, up, up_to, down, down_from))
                at, c, w, u, y = to[at[rows]], c[rows], w[rows], u[rows], y[rows]
                part, rule = np.unique(part[stay], return_inverse=True)[1], np.unique(rule[rows], return_inverse=True)[1]
    return out


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(var, value) of candidates sorted by part; whole parts are solved at once, some TOGETHER candidates or more at a time."""

    def values(df: pd.DataFrame) -> pd.DataFrame:
        rules = _local_rules(*(df[k].to_numpy() for k in ("x", "y", "pair", "to_a", "to_b")))
        return pd.DataFrame({"var": df["var"], "value": local_admm({k: df[k].to_numpy() for k in ("up", "up_to", "down", "down_from")}, df["part"].to_numpy(), *rules)})

    held: list[pd.DataFrame] = []
    for df in batches:
        held.append(df)
        if sum(map(len, held)) >= TOGETHER:
            both = pd.concat(held, ignore_index=True)
            open_ = both["part"] == both["part"].iloc[-1]
            held = [both[open_]]
            if not open_.all():
                yield values(both[~open_])
    if held and sum(map(len, held)):
        yield values(pd.concat(held, ignore_index=True))


def solve(cand: DataFrame, residuals: list | None = None, together: int = TOGETHER, merged: int = MERGED) -> DataFrame:
    """(var, value) at the minimum. Candidates that don't hang together share no rule, so each connected part is a problem of
    its own: parts of up to `together` candidates are solved in tasks, larger ones in DataFrames round by round."""
    edges = cand.withColumns({"x": F.xxhash64("a"), "y": F.xxhash64("b")})
    edges = settle(with_parts(edges, merged), "parts")
    large = settle(edges.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > together), "large")
    rows = edges.join(large, "part", "left_anti").select("part", "var", "x", "y", (~F.col("hint")).alias("pair"), F.xxhash64("source_a").alias("to_a"), F.xxhash64("source_b").alias("to_b"), "up", "up_to", "down", "down_from")
    values = rows.repartition(parallelism(cand.sparkSession), "part").sortWithinPartitions("part").mapInPandas(_solved, "var long, value double")
    if large.isEmpty():
        return values
    rest = settle(edges.join(large, "part", "left_semi").drop("part", "x", "y"), "rest")
    return values.unionByName(admm(rest.select("var", "up", "up_to", "down", "down_from"), settle(_rules(rest), "rules"), residuals=residuals))


def link(places: DataFrame, reviews: DataFrame, cities: DataFrame, residuals: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, members, mentions): matches of records and hints (a, b, hint, confidence), place_id -> record, raw_id -> hint."""
    spark = places.sparkSession
    recs, members = place_records(places, cities)
    recs = settle(recs.where("name is not null"), "records")
    words, epithets = common_words(recs, "name")
    words, epithets = settle(words, "words"), settle(epithets, "epithets")
    recs = settle(with_names(recs.repartition(parallelism(spark)), "name", words, epithets).drop("name"), "named")

    # one hint for each way of writing, place and city
    usable = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lng") == 0))
    hints = reviews.where(F.length(F.trim("restaurant_hint")) > 0).select(
        "raw_id", F.trim("restaurant_hint").alias("hint"), "city_id", F.when(usable, F.col("lat")).alias("lat"), F.when(usable, F.col("lng")).alias("lng")
    )
    hid = F.concat(F.lit("hint|"), F.sha2(F.concat_ws("|", "hint", F.coalesce("city_id", F.lit("")), F.coalesce(F.col("lat").cast("string"), F.lit("")), F.coalesce(F.col("lng").cast("string"), F.lit(""))), 256).substr(1, 24))
    hints = hints.withColumn("rid", hid)
    mentions = hints.select("raw_id", "rid")
    uniq = hints.groupBy("rid").agg(F.first("hint").alias("hint"), F.first("city_id").alias("city_id"), F.first("lat").alias("lat"), F.first("lng").alias("lng"))
    uniq = settle(with_names(uniq.repartition(parallelism(spark)), "hint", words, epithets), "hints")

    # candidates of records: near each other, or by keys where one lies nowhere
    placed = recs.where("lat is not null")
    name_keys = F.transform(_deletions("sound"), lambda k: F.concat(F.lit("n|"), k))
    keys = F.concat(name_keys, F.array_compact(F.array(F.concat(F.lit("a|"), "addr"), F.concat(F.lit("t|"), "tel"))))
    keyed = recs.select("rid", "source", F.col("lat").isNull().alias("lost"), F.explode(keys).alias("key"))
    x, y = keyed.where("lost").alias("x"), keyed.alias("y")
    twins = x.join(y, F.expr("x.key = y.key and x.rid <> y.rid and x.source <> y.source"))
    by = lambda k: F.max(F.col("x.key").startswith(k + "|"))
    twins = twins.groupBy(F.col("x.rid").alias("rid"), F.col("y.rid").alias("twin")).agg(by("n").alias("named"), by("a").alias("addr"), by("t").alias("tel"))
    traits = ("core", "kinds", "lead", "joined")
    twins = twins.join(recs.select("rid", F.struct(*traits).alias("x")), "rid").join(recs.select(F.col("rid").alias("twin"), F.struct(*traits).alias("y"), "lat", "lng", F.col("cities").alias("there")), "twin")
    # an address or phone alone needs a name that is alike at all
    twins = twins.withColumn("like", compare_names("x.core", "y.core", "x.kinds", "y.kinds", "x.joined", "y.joined")).where("like.name > 0.55 or addr and tel")
    apart = lambda c: (F.size(f"x.{c}") > 0) & (F.size(f"y.{c}") > 0) & ~F.arrays_overlap(f"x.{c}", f"y.{c}")
    proof = F.when(apart("kinds") | apart("lead"), 0).when(F.expr("addr and tel"), 4).when(F.expr("named and (addr or tel)"), 3).when(F.expr("x.core = y.core"), 2).when(F.col("named"), 1).otherwise(0)
    spot = F.when(F.col("lat").isNotNull(), F.struct(F.round(F.col("lat") * 20).alias("y"), F.round(F.col("lng") * 20).alias("x")))
    twins = settle(twins.select("rid", "twin", proof.alias("proof"), spot.alias("spot"), "there"), "twins")
    # near each other, records and hints in one sweep; what a hint may mean it also passes on, so it meets all records with twins
    code = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.xxhash64(c))
    outline = lambda df, hint: df.where("lat is not null").select("rid", "lat", "lng", F.lit(hint).alias("hint"), (F.size("kinds") > 0).alias("kinded"), "twinned", *[code(c).alias(k) for c, k in (("source", "src"), ("addr", "addr"), ("tel", "tel"))], outlines("core", "joined").alias("o"))
    blank = uniq.withColumns({"source": F.lit("hint"), "addr": F.lit(None).cast("string"), "tel": F.lit(None).cast("string")})
    twinned = twins.where("spot is not null").select(F.col("twin").alias("rid")).distinct().withColumn("twinned", F.lit(True))
    spread = outline(recs.join(twinned, "rid", "left").withColumn("twinned", F.coalesce("twinned", F.lit(False))), False).unionByName(outline(blank.withColumn("twinned", F.lit(False)), True))
    spread = settle(spread.select("*", "o.*").drop("o"), "outlines")
    near = settle(near_positions(spread, REACH_M, give=("rid", "hint"), keep_pair=_may_match), "near")
    discard(spread)
    h_near = near.where("hint_a or hint_b").select(F.when(F.col("hint_a"), F.col("rid_a")).otherwise(F.col("rid_b")).alias("a"), F.when(F.col("hint_a"), F.col("rid_b")).otherwise(F.col("rid_a")).alias("b"), "distance_m")
    near = near.where("not hint_a and not hint_b").select(F.least("rid_a", "rid_b").alias("a"), F.greatest("rid_a", "rid_b").alias("b"), "distance_m")
    nowhere = F.lit(None).cast("double").alias("distance_m")
    lost = twins.select(F.least("rid", "twin").alias("a"), F.greatest("rid", "twin").alias("b"), nowhere).distinct()
    side = lambda df, s, k: df.select(F.col("rid").alias(k), *[F.col(c).alias(c + s) for c in ("source", "core", "kinds", "lead", "joined", "addr", "tel")])
    pairs = near.unionByName(lost).join(side(recs, "_a", "a"), "a").join(side(recs, "_b", "b"), "b").where("source_a <> source_b").withColumns({"hint": F.lit(False), "sure": F.lit(True)})

    # candidates of hints: records around them, or, without coordinates, records of their city whose name differs by a letter at most; and the twins of both that lie nowhere
    # chains, also misspelt, name no single place
    chains = recs.join(settle(chain_names(recs), "chain-names"), ["core", "kinds"], "left_semi").select("sound").distinct().select(F.explode(_deletions("sound")).alias("k")).distinct()
    in_chain = settle(recs.select("rid", "sound").unionByName(uniq.select("rid", "sound")).select("rid", F.explode(_deletions("sound")).alias("k")).join(chains, "k", "left_semi").select("rid").distinct(), "in-chain")
    single = lambda df: df.join(in_chain, "rid", "left_anti")
    floating = single(uniq.where("lat is null")).select("rid", F.col("city_id").alias("city"), F.explode(_deletions("sound")).alias("k"))
    anywhere = single(uniq).select("rid", "core", F.explode(_deletions("sound")).alias("k"))
    # a record that lies nowhere is at home at the one spot of its best twins of no other kind, or, if it has none of its very name, anywhere
    twins = twins.where("spot is not null")
    twins = twins.withColumn("best", (F.col("proof") > 0) & (F.col("proof") == F.max("proof").over(W.partitionBy("rid"))))
    fits = twins.where("best").groupBy("rid").agg(F.countDistinct("spot").alias("spots"), F.max("proof").alias("proof"), F.array_distinct(F.flatten(F.collect_list("there"))).alias("there"))
    adrift = single(recs.where("lat is null")).join(fits, "rid", "left").withColumn("k", F.explode(_deletions("sound")))
    adrift = settle(adrift.select("rid", F.coalesce("spots", F.lit(0)).alias("spots"), F.coalesce("proof", F.lit(0)).alias("proof"), "core", "there", "k"), "adrift")
    homes = single(placed).select("rid", F.explode("cities").alias("city"), F.explode(_deletions("sound")).alias("k")).unionByName(adrift.where("spots = 1").select("rid", F.explode("there").alias("city"), "k"))
    free = adrift.where("proof < 2").select("rid", "core", "proof", "k")
    h_named = floating.alias("h").join(homes.alias("r"), ["city", "k"]).select(F.col("h.rid").alias("a"), F.col("r.rid").alias("b"))
    h_named = settle(h_named.unionByName(anywhere.alias("h").join(free.alias("r"), "k").where("r.proof = 0 or h.core = r.core").select(F.col("h.rid").alias("a"), F.col("r.rid").alias("b"))).distinct(), "h-named")
    # what a hint may mean it passes on to the twins that lie nowhere; where their spot is open, without support of its own, only by transitivity
    via = twins.join(fits.select("rid", "spots"), "rid", "left").select(F.col("twin").alias("b"), F.col("rid").alias("lost"), F.coalesce(F.col("best") & (F.col("spots") == 1), F.lit(False)).alias("sure"))
    h_twin = h_near.select("a", "b").unionByName(h_named).join(via, "b").groupBy("a", F.col("lost").alias("b")).agg(F.max("sure").alias("sure")).join(h_named, ["a", "b"], "left_anti")
    h_all = h_near.withColumn("sure", F.lit(True)).unionByName(h_named.select("a", "b", nowhere, F.lit(True).alias("sure"))).unionByName(h_twin.select("a", "b", nowhere, "sure"))
    h_pairs = h_all.join(side(blank, "_a", "a"), "a").join(side(recs, "_b", "b"), "b").withColumn("hint", F.lit(True))

    cols = ["a", "b", "hint", "sure", "distance_m", "source_a", "source_b", "core_a", "core_b", "kinds_a", "kinds_b", "lead_a", "lead_b", "joined_a", "joined_b", "addr_a", "addr_b", "tel_a", "tel_b"]
    cand = pairs.select(*cols).unionByName(h_pairs.select(*cols)).repartition(parallelism(spark))
    cand = cand.withColumn("like", compare_names("core_a", "core_b", "kinds_a", "kinds_b", "joined_a", "joined_b"))
    name = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("like.name") - 0.55) / 0.3))
    same_addr, same_tel = F.coalesce(F.col("addr_a") == F.col("addr_b"), F.lit(False)), F.coalesce(F.col("tel_a") == F.col("tel_b"), F.lit(False))
    # without coordinates the same name goes before one a letter off; it is faint evidence without an address or phone
    unplaced = F.col("distance_m").isNull() & ~F.col("hint")
    exact = unplaced & (F.col("core_a") == F.col("core_b"))
    faint = unplaced & ~exact & ~same_addr & ~same_tel
    close = F.when(faint, 0.65).when(F.col("distance_m").isNull(), 0.85).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (REACH_M - F.col("distance_m")) / 90.0)))
    other_addr, other_tel = F.coalesce(F.col("addr_a") != F.col("addr_b"), F.lit(False)), F.coalesce(F.col("tel_a") != F.col("tel_b"), F.lit(False))
    other_lead = (F.size("lead_a") > 0) & (F.size("lead_b") > 0) & ~F.arrays_overlap("lead_a", "lead_b")
    support = F.greatest(name * close, F.when(same_addr | same_tel, F.greatest(name, F.lit(0.3)) * F.greatest(close, F.lit(0.5))).otherwise(0.0))
    w = lambda c, x: F.when(c, x).otherwise(0.0)
    cand = cand.select(
        F.xxhash64("a", "b").alias("var"), "a", "b", "hint", "source_a", "source_b",
        w(F.col("sure"), F.when(faint, 1.5).otherwise(4.0) + w(same_addr, 3.0) + w(same_tel, 2.0) + w(exact, 2.0)).alias("up"), support.alias("up_to"),
        (0.8 + 5.0 * F.col("like.kind") + w(other_addr, 3.0) + w(other_tel, 2.5) + w(other_lead, 1.5)).alias("down"), F.lit(0.0).alias("down_from"),
    ).where(F.col("up_to") > LEAST_SUPPORT)
    cand = settle(cand, "candidates")

    values = solve(cand, residuals)
    matches = cand.select("var", "a", "b", "hint").join(values, "var").select("a", "b", "hint", F.col("value").alias("confidence"))
    return matches, members, mentions
