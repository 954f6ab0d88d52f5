"""Personal information in free text: typed spans by a character BiLSTM with a CRF, and placeholders.

The tagger is trained in numpy on the driver from labelled spans: a bounded sample of the rows (`sample_rows`, the
rows of smallest hash of their id) is labelled by patterns and a list of names that grows from authors who carry one
known and one unknown name; copies with other names, digits and formats are added. Every text of every row is then
tagged whole, in overlapping windows whose emissions are blended before one global decoding. A span counts only if an
exact check finds in it what its kind needs (digits for a number, a house number and a word for an address, ...).

Defined results: null or empty text has no spans and stays as it is; a text may hold any number of spans, they never
overlap; equal rows get equal spans; an empty table or a table without any labelled span gives no spans; other columns
are not read. Very long texts are tagged whole in windows of `window` characters.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.chartagger import CharTagger, encode
from tastegrid.llm.models import stored
from tastegrid.session import spread

KINDS = ["email", "phone", "id_number", "address", "name"]
DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
STREETS = "lane|street|road|avenue|wynd|sarani|cross|square|marg|gali|ln|st|rd|ave|straße|strasse|platz|rue|calle|plaza|boulevard|drive"
FIRMS = "sons|bros|brothers|sweets|grill|cafe|café|bakery|kitchen|restaurant|hotel|stores?|house|snacks|dhaba|eatery|caterers|catering|foods|co|ltd"
TITLES = r"mr|mrs|ms|dr|shri|smt|prof|herr|frau|sr|sra|mme|m"

EMAIL = re.compile(
    r"(?:[a-z0-9\-]+ dot )?[a-z0-9][a-z0-9._%+\-]*(?:(?:@|\s?\(at\)\s?|\s?\[at\]\s?)[a-z0-9][a-z0-9\-]*(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)[a-z0-9\-]+)+|\sat\s[a-z0-9][a-z0-9\-]*(?:\sdot\s[a-z0-9\-]+)+)", re.I
)
ID = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[a-z]\d{7,8}|[a-z]{5}\d{4}[a-z]|\d{4}([ -])\d{4}\1\d{4})(?![\w-])", re.I)
NOT_ID = re.compile(r"(?:order|bill|token|invoice|receipt|coupon)\s*(?:no|nr|number|id)?\.?:?\s*#?$", re.I)
PHONE = re.compile(r"(?<![\w.,/-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,}(?:[ .-]\d{2,}){0,5}(?![\w/-]|[.,]\d)|(?<![\w.,/-])\+\d{1,3} \d(?: \d{2}){4}(?!\w)")
SPELLED = re.compile(rf"(?<!\w)(?:(?:{DIGIT_WORDS}|double|triple)[ \-,]+){{6,}}(?:{DIGIT_WORDS})(?!\w)", re.I)
ADDRESS = re.compile(
    rf"(?<!\w)(?:flat \d+,? |no\.? )?\d{{1,4}}[a-z]?(?:/\d+)?,? (?:[^\W\d_][\w'-]* ){{1,3}}(?:{STREETS})(?!\w)\.?(?:, \d\w\w floor)?|(?<!\w)(?:[^\W\d_][\w'-]* ){{1,2}}(?:{STREETS})\.? \d{{1,4}}[a-z]?(?:/\d+)?(?![\w.])(?! (?:minutes|minute|people|pieces|times))", re.I
)


#: what follows a name that is the beginning of an e-mail address
PART_OF_ADDRESS = re.compile(r"\.\w|@\w|\s?[\[(]at[\])]")


def _names_pattern(names: set[str]) -> re.Pattern | None:
    if not names:
        return None
    one = "(?:" + "|".join(sorted(map(re.escape, names), key=lambda x: (-len(x), x))) + ")"
    return re.compile(rf"(?<![\w@.+\-/])(?:(?:{TITLES})\.? )?{one}(?:,? (?:[a-z]\. )?{one}| [a-z]\.(?= [a-z]))*(?![\w@+\-]|\.\w)", re.I)


def grow_names(names: set[str], authors: list[str], rounds: int = 3) -> set[str]:
    """Adds the unknown half of two-part authors whose other half is known."""
    names = {n.lower() for n in names}
    pairs = []
    for a in set(authors):
        m = re.fullmatch(r"([^\W\d_][\w'\-]+),? (?:[A-Za-z]\. )?([^\W\d_][\w'\-]+)", a.strip())
        if m:
            pairs.append((m[1].lower(), m[2].lower()))
    for _ in range(rounds):
        more = {b for a, b in pairs if a in names} | {a for a, b in pairs if b in names}
        if more <= names:
            break
        names |= more
    return names


def label_spans(text: str, pattern: re.Pattern | None) -> list[tuple[int, int, int]]:
    """Labelled spans (start, end, kind) by patterns: training material, not the detector."""
    taken = np.zeros(len(text) + 1, bool)
    out = []

    def take(a: int, b: int, kind: int) -> None:
        if b > a and not taken[a:b].any():
            taken[a:b] = True
            out.append((a, b, kind))

    for m in EMAIL.finditer(text):
        take(m.start(), m.end(), 0)
    for m in ID.finditer(text):
        if not NOT_ID.search(text[: m.start()]):
            take(m.start(), m.end(), 2)
        else:
            taken[m.start() : m.end()] = True
    for m in SPELLED.finditer(text):
        take(m.start(), m.end(), 1)
    for m in PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if 9 <= digits <= 14 and not re.search(r"https?:\S*$", text[: m.start()]) and not NOT_ID.search(text[: m.start()]):
            take(m.start(), m.end(), 1)
    for m in ADDRESS.finditer(text):
        take(m.start(), m.end(), 3)
    if pattern is not None:
        for m in pattern.finditer(text):
            after = text[m.end() : m.end() + 24]
            before = text[max(0, m.start() - 12) : m.start()]
            if re.match(rf"(?:'s)? ?(?:(?:and|&|&amp;) )?(?:{FIRMS})\b", after, re.I) or re.search(r"(?:@|#|/|\bthe old |\bthe )$", before, re.I):
                continue
            take(m.start(), m.end(), 4)
    return sorted(out)


def _pseudo_name(r: random.Random) -> str:
    on, vo, co = "b br ch d dh f g gh h j k kr l m n p r s sh st t th tr v w y z".split(), "a e i o u ai ee oo".split(), "n r l k m sh t v nd rn ld st x".split()
    n = r.choice((2, 2, 3))
    return "".join(r.choice(on) + r.choice(vo) for _ in range(n - 1)).capitalize() + r.choice(on) + r.choice(vo) + r.choice(co)


def _restyle(name: str, r: random.Random) -> str:
    return r.choice((name, name, name.upper(), name.lower()))


def _vary(piece: str, kind: int, r: random.Random, names: list[str]) -> str:
    """Another item of the same kind in the same format; every third new name is made up."""
    if kind == 4:
        style = str.upper if piece.isupper() else str.lower if piece.islower() else str
        titles = set(TITLES.split("|"))
        return re.sub(r"[^\W\d_][\w'\-]{2,}", lambda m: m[0] if m[0].lower() in titles else style(r.choice(names).title() if names and r.random() < 0.67 else _pseudo_name(r)), piece)
    if kind == 1 and not any(c.isdigit() for c in piece):
        words = DIGIT_WORDS.split("|")
        return re.sub(r"[a-z]+", lambda m: r.choice(words), piece.lower())
    out = re.sub(r"\d", lambda m: str(r.randrange(10)), piece)
    if kind == 2:
        out = re.sub(r"[A-Za-z]", lambda m: r.choice("abcdefghijklmnopqrstuvwxyz".upper() if m[0].isupper() else "abcdefghijklmnopqrstuvwxyz"), out)
    if kind == 0:
        at = re.search(r"@|\s?[\[(]?at[\])]?\s?", out)
        if at and at.start() > 1:
            user = _pseudo_name(r).lower() + r.choice(("", ".", "_", "+")) + r.choice(("", str(r.randrange(1000)), _pseudo_name(r).lower()))
            user = user.rstrip("._+")
            out = (user.upper() if piece.isupper() else user) + out[at.start() :]
    return out


def training_windows(fields: list[tuple[int, str]], pattern: re.Pattern | None, names: list[str], seed: int, per_class: int, size: int = 72):
    """Windows of labelled text: all spans, varied copies of them, and stretches without spans."""
    r = random.Random(seed)
    texts, labels = [], []

    def add(text: str, spans) -> None:
        y = np.zeros(len(text), np.int8)
        for a, b, k in spans:
            y[a:b] = 2 * k + 2
            y[a] = 2 * k + 1
        texts.append(text)
        labels.append(y)

    def cut(text: str, spans, about: tuple[int, int] | None) -> None:
        if about is None:
            a = r.randrange(max(1, len(text) - size + 1))
        else:
            a = max(0, min(about[0] - r.randrange(8, 50), len(text) - size))
        b = min(len(text), a + size)
        # a span is never cut: the window shrinks instead
        for s, e, _ in spans:
            if s < a < e:
                a = e
            if s < b < e:
                b = s
        if b > a:
            add(text[a:b], [(s - a, e - a, k) for s, e, k in spans if a <= s and e <= b])

    # the rarest come first: at most `each` windows of one (field, kind), and of each class of windows without spans
    quota: dict = {}

    def room(what, each: int) -> bool:
        quota[what] = quota.get(what, 0) + 1
        return quota[what] <= each

    for field, text in fields:
        spans = label_spans(text, pattern)
        if not spans:
            number = re.search(r"\d{3,}[ .:/-]\d[\d .:/-]+", text) or re.search(r"\d[\d .:/-]{2,}", text)
            shape = "long number" if number and number.end() - number.start() > 6 else "number" if number else "upper" if text.isupper() else "words" if " " in text else "word"
            if room((field, shape), per_class * ((8 if shape == "words" else 2 if shape == "number" else 1) if field == 0 else 3 if shape == "word" else 1)):
                cut(text, spans, None)
                if field == 0 and number:
                    cut(text, spans, number.span())
                if r.random() < 0.15:
                    cut(r.choice((str.upper, str.lower))(text) if len(text.upper()) == len(text) else text.lower(), spans, None)
            continue
        new, at, moved = "", 0, []
        for s, e, k in spans:
            new += text[at:s]
            piece = _vary(text[s:e], k, r, names)
            moved.append((len(new), len(new) + len(piece), k))
            new, at = new + piece, e
        new += text[at:]
        for s, t in zip(spans, moved):
            if room((field, s[2]), per_class if field == 0 else per_class // 2):
                cut(text, spans, s[:2])
                cut(new, moved, t[:2])
                if r.random() < 0.12 and len(new.upper()) == len(new):
                    cut(r.choice((str.upper, str.lower))(new), moved, t[:2])
    return texts, labels


def ordinary_words(df: DataFrame, text: str, least: int = 5, share: float = 1 / 6000) -> set[str]:
    """Words of at least `least` texts and `share` of all texts that are mostly written small, from all rows.

    A text of w words has at most w such words, so there are at most (mean words a text) / share of them on the driver."""
    total = df.where(F.col(text).isNotNull()).agg(F.count("*").alias("texts"))
    ws = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("w"))
    per = ws.groupBy("w").agg(F.count("*").alias("c")).groupBy(F.lower("w").alias("low")).agg(F.sum("c").alias("c"), F.sum(F.when(F.col("w") == F.lower("w"), F.col("c")).otherwise(0)).alias("small"))
    per = per.crossJoin(F.broadcast(total))  # one row of one number
    return {r["low"] for r in per.where((F.col("c") >= least) & (F.col("c") >= F.col("texts") * share) & (2 * F.col("small") >= F.col("c"))).select("low").collect()}


def fit_tagger(texts: list[str], authors: list[str], names: set[str], ordinary: set[str] = frozenset(), hidden: int = 32, epochs: int = 7, max_windows: int = 14_000, mine_texts: int = 6_000, least_steps: int = 200, seed: int = 7) -> tuple[CharTagger, list[float]]:
    """Trains on at most max_windows windows of the sample, spread over fields, kinds and classes of texts without spans; what it
    wrongly finds in mine_texts of them is trained on again. Both bound training material only. Small samples are gone through
    more often, for at least least_steps batches."""
    names = grow_names(names, authors)
    pattern = _names_pattern(names)
    fields = [(0, t) for t in texts if t] + [(1, a) for a in authors if a]
    r = random.Random(seed)
    r.shuffle(fields)
    ws, ys = training_windows(fields, pattern, sorted(names), seed, max_windows // 32)
    pick = list(range(len(ws)))
    r.shuffle(pick)
    pick = pick[:max_windows]
    has = [i for i in pick if ys[i].any()]
    model = CharTagger(2 * len(KINDS) + 1, hidden, seed)
    model.ordinary = set(ordinary) - names
    if not has:
        model.p["bias"][0] = 50.0
        return model, []
    losses = _fit(model, [ws[i] for i in pick], [ys[i] for i in pick], max(epochs - 2, -(-least_steps // -(-len(pick) // 128))), 0.012, seed)
    # what the tagger wrongly finds in texts without labelled spans becomes further training material
    again, hard = [i for i in pick if r.random() < 0.8], []
    plain = [(f, t) for f, t in fields if not label_spans(t, pattern)][:mine_texts]
    model.compile()
    for (f, t), spans in zip(plain, spans_of(model, [t for _, t in plain])):
        for a, b, _ in spans[:2]:
            a = max(0, min(a - r.randrange(8, 50), len(t) - 72))
            hard.append(t[a : max(b, a + 72)][:200])
    hard = hard[: max_windows // 5]
    ws, ys = [ws[i] for i in again] + hard, [ys[i] for i in again] + [np.zeros(len(t), np.int8) for t in hard]
    return model, losses + _fit(model, ws, ys, 2, 0.004, seed + 1)


def _fit(model: CharTagger, ws: list[str], ys: list[np.ndarray], epochs: int, rate: float, seed: int) -> list[float]:
    lengths = np.array([len(w) for w in ws])
    x, y = np.zeros((len(ws), int(lengths.max())), np.uint8), np.zeros((len(ws), int(lengths.max())), np.int8)
    ids, at = encode(ws)
    for row, labels in enumerate(ys):
        x[row, : lengths[row]] = ids[at[row] : at[row + 1]]
        y[row, : lengths[row]] = labels
    return model.fit(x, lengths, y, epochs=epochs, rate=rate, seed=seed)


def _checked(kind: str, piece: str, ordinary: set[str] | frozenset) -> bool:
    """What the kind cannot do without; a name isn't made of ordinary words alone."""
    low = piece.lower()
    digits = sum(c.isdigit() for c in piece)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", low) and re.search(r"\.|\bdot\b", low))
    if kind == "phone":
        return digits + len(re.findall(rf"\b(?:{DIGIT_WORDS})\b", low)) >= 7
    if kind == "id_number":
        return digits >= 4
    if kind == "address":
        return digits >= 1 and sum(c.isalpha() for c in piece) >= 3
    words = [w for w in re.findall(r"[^\W\d_]{2,}", low) if w not in TITLES.split("|")]
    return digits == 0 and bool(words) and "@" not in piece and not all(w in ordinary for w in words)


def spans_of(model: CharTagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    out = []
    for text, y in zip(texts, model.tag(texts)):
        spans = []
        if y.any():
            kind = (y + 1) // 2
            edges = np.flatnonzero((np.diff(kind, prepend=0) != 0) | ((y % 2 == 1) & (y > 0)))
            for a, b in zip(edges, [*edges[1:], len(y)]):
                if kind[a] and (piece := text[a:b].rstrip(" .,;)")) and _checked(KINDS[kind[a] - 1], piece, model.ordinary) and not (kind[a] == 5 and PART_OF_ADDRESS.match(text[a + len(piece) :])):
                    spans.append((int(a), int(a) + len(piece), KINDS[kind[a] - 1]))
        out.append(spans)
    return out


def fit_on(spark: SparkSession, df: DataFrame, id_col: str, text: str, author: str, names: DataFrame, sample_rows: int = 40_000, most_names: int = 100_000, table: str = "", **kw) -> CharTagger:
    """Trains on the sample_rows rows with the smallest hash of their id and the most_names names with the smallest hash of
    theirs; both only bound what labels the training material. Ordinary words are counted in all rows."""
    sample = df.select(id_col, text, author).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).toPandas()
    listed = names.where("name_token is not null").select("name_token").distinct().orderBy(F.xxhash64("name_token"), "name_token").limit(most_names)
    known = {str(n) for n in listed.toPandas()["name_token"]}
    texts, authors = sample[text].dropna().tolist(), sample[author].dropna().tolist()

    def fit() -> CharTagger:
        ordinary = ordinary_words(df, text)
        return fit_tagger(texts, authors, known, ordinary=ordinary, **kw)[0]

    return stored(spark, table, "pii", (sample_rows, most_names, sorted(kw.items())), [*texts, None, *authors, None, *sorted(known)], fit)


def tag_fields(df: DataFrame, id_col: str, fields: list[str], model: CharTagger, chunk: int = 2000) -> DataFrame:
    """(id, and for each field f: f, f_spans array<struct<start,stop,kind>>); offsets in code points. Equal texts of a batch are tagged once."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.h, model.k, model.p, model.ordinary))
    struct = "array<struct<start:int,stop:int,kind:string>>"
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{f} string, {f}_spans {struct}" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, k, p, ordinary = shared.value
        m = CharTagger(k, h)
        m.p, m.ordinary = p, ordinary
        m.compile()
        for got in batches:
            for a in range(0, len(got), chunk):
                part = got.iloc[a : a + chunk]
                cols = {id_col: part[id_col]}
                for f in fields:
                    texts = [t if isinstance(t, str) else "" for t in part[f]]
                    once = list(dict.fromkeys(texts))
                    spans = dict(zip(once, ([{"start": s, "stop": e, "kind": k2} for s, e, k2 in x] for x in spans_of(m, once))))
                    cols[f] = part[f]
                    cols[f + "_spans"] = [spans[t] for t in texts]
                yield pd.DataFrame(cols)

    return spread(df.select(id_col, *fields)).mapInPandas(run, schema)


def redacted(field: str) -> F.Column:
    """The field with every span replaced by its kind in brackets; the rest unchanged."""
    spans, text = F.col(field + "_spans"), F.col(field)
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["s"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("s"), x["stop"].alias("at")
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(step["s"], text.substr(step["at"] + 1, F.length(text)))).otherwise(text)
