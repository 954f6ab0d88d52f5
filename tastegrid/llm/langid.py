"""Languages of documents and of their sentences, by multilingual mixture inference.

Character n-gram likelihoods of each language are learnt from a bounded sample of labelled rows (`sample_rows`, those of
smallest hash of their id); as labels may be wrong or stand for mixed texts, the sample's sentences are reassigned to
their likeliest language and the counts taken anew, `rounds` times. Each document is then a mixture: expectation
maximisation over its sentences estimates the shares of the languages, and a language is added to the document's set
only while the mixture's log-likelihood grows by more than a penalty. Texts are read whole.

Defined results: null, empty and wordless texts (no letters besides links and addresses) have no language; ties go to
the language that comes first among the names; equal texts get equal results; an empty table gives no rows; without any
labelled row all languages are equally likely and the confidence is 1 / their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.models import stored
from tastegrid.session import spread

#: the languages told apart unless others are given
LANGUAGES = ["en", "hi", "hi-Latn", "bn", "bn-Latn", "es", "fr", "de"]
BUCKETS = 1 << 17
NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|[@#]\w+|&(?:[a-z]+|#\d+);")
MARKS = re.compile(r"[@#&]|://|www")  # NOISE needs one of these
END = re.compile(r"(?:(?<!\bRs)(?<!\brs)(?<!\bMr)(?<!\bDr)(?<!\bMs)(?<!\bNo)(?<!\bno)(?<!\bSt)(?<!\b[A-Z])[.!?।]+|\n+)(?:\s+|$)")
HAS_LETTER = re.compile(r"[^\W\d_]")
NOT_ASCII_LETTER = re.compile(r"[^a-z]+")
NOT_LETTER = re.compile("[^\\w\u0900-\u09ff]+|[0-9_।॥]+")
WORD = re.compile(r"[^\W\d_][^\W\d_ऀ-৿]*(?:['’ऀ-৿][^\W\d_ऀ-৿]*)*")


def label_of(col: Column) -> Column:
    """A label's language: region and case dropped, -Latn kept; null where it names no language."""
    parts = F.split(F.translate(F.lower(F.trim(col)), "_", "-"), "-")
    base = F.when(parts[0].isin("", "und", "unknown", "null", "none"), None).otherwise(parts[0])
    return F.when(F.array_contains(parts, "latn"), F.concat(base, F.lit("-Latn"))).otherwise(base)


def _few(piece: str, least: int) -> bool:
    """Whether the piece has fewer than `least` words."""
    found = WORD.finditer(NOISE.sub(" ", piece) if MARKS.search(piece) else piece)
    return sum(1 for _ in islice(found, least)) < least


def sentences(text: str, least_words: int = 3) -> list[tuple[int, int]]:
    """(start, stop) of stretches of at least `least_words` words where there are that many; no character is lost."""
    cuts = [0, *[m.end() for m in END.finditer(text)]]
    if len(cuts) == 1 or len(cuts) == 2 and cuts[1] == len(text):
        return [(0, len(text))] if text else []
    if cuts[-1] < len(text):
        cuts.append(len(text))
    out: list[list[int]] = []
    short = True
    for a, b in zip(cuts, cuts[1:]):
        few = _few(text[a:b], least_words)
        if out and (few or short):
            out[-1][1] = b
            short = short and _few(text[out[-1][0] : b], least_words)
        else:
            out.append([a, b])
            short = few
    return [(a, b) for a, b in out]


def _grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (1 to 4 characters, with word borders) of all pieces, end to end, and the pieces' offsets."""
    norm = []
    for p in pieces:
        s = (NOISE.sub(" ", p) if MARKS.search(p) else p).lower()
        s = NOT_ASCII_LETTER.sub(" ", s) if s.isascii() else NOT_LETTER.sub(" ", s)
        norm.append(" " + " ".join(s.split()) + "  ")
    size = np.array([len(s) for s in norm])
    at = np.concatenate([[0], np.cumsum(size)])
    cps = np.frombuffer("".join(norm).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    pad = np.concatenate([cps, np.zeros(4, np.uint64)])
    n = len(cps)
    out = np.empty((4, n), np.int32)
    h = np.zeros(n, np.uint64)
    for k in range(4):
        h = (h * np.uint64(0x9E3779B1) + pad[k : k + n] + np.uint64(k + 1)) & np.uint64(0xFFFFFFFFFFFF)
        x = (h ^ (h >> np.uint64(17))) * np.uint64(0x85EBCA6B)
        out[k] = ((x ^ (x >> np.uint64(23))) % np.uint64(BUCKETS)).astype(np.int32)
    return out, at


class Languages:
    """Log-probabilities of hashed n-grams by language."""

    def __init__(self, table: np.ndarray, names: list[str] = LANGUAGES) -> None:
        self.table, self.names = table, list(names)  # (BUCKETS, languages)

    @classmethod
    def train(cls, texts: list[str], labels: list[str | None], rounds: int = 3, names: list[str] = LANGUAGES) -> Languages:
        k = len(names)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for a, b in sentences(t):
                pieces.append(t[a:b])
                owner.append(i)
        place = {name: j for j, name in enumerate(names)}
        given = np.array([place.get(labels[i], -1) if labels[i] else -1 for i in owner], dtype=np.int64)
        if not pieces or not (given >= 0).any():
            return cls(np.zeros((BUCKETS, k), np.float32), names)
        grams, at = _grams(pieces)
        of = np.repeat(np.arange(len(pieces)), np.diff(at))
        now = given.copy()
        for _ in range(rounds + 1):
            counts = np.full((BUCKETS, k), 0.05)
            on = now[of] >= 0
            place_of = now[of][on]
            for row in grams:
                counts += np.bincount(row[on].astype(np.int64) * k + place_of, minlength=BUCKETS * k).reshape(BUCKETS, k)
            model = cls(np.log(counts / counts.sum(0)).astype(np.float32), names)
            score = model._sum(grams, at)
            now = score.argmax(1)
        return model

    def _sum(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        each = self.table[grams[0]] + self.table[grams[1]] + self.table[grams[2]] + self.table[grams[3]]
        return np.add.reduceat(each, at[:-1], axis=0)

    def score(self, pieces: list[str]) -> np.ndarray:
        """Log-likelihood of each piece by language, scaled down as overlapping n-grams are not independent."""
        if not pieces:
            return np.zeros((0, len(self.names)), np.float32)
        return self._sum(*_grams(pieces)) / 4.0


def mixture(score: np.ndarray, penalty: float = 10.0, steps: int = 15) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Languages of a document from its sentences' log-likelihoods: the set, its shares, and posteriors (sentences, set)."""

    def em(langs: list[int]):
        s = score[:, langs]
        pi = np.full(len(langs), 1.0 / len(langs))
        for _ in range(steps if len(langs) > 1 else 1):
            z = s + np.log(pi + 1e-12)
            top = z.max(1, keepdims=True)
            post = np.exp(z - top)
            total = post.sum(1, keepdims=True)
            post /= total
            pi = post.mean(0)
        return float((top[:, 0] + np.log(total[:, 0])).sum()), pi, post

    langs = [int(score.sum(0).argmax())]
    best, pi, post = em(langs)
    while len(langs) < min(len(score), score.shape[1]):
        reach = np.maximum(score, score[:, langs].max(1, keepdims=True)).sum(0)
        reach[langs] = -np.inf
        more = [*langs, int(reach.argmax())]
        value, pi2, post2 = em(more)
        if value - best <= penalty:
            break
        langs, best, pi, post = more, value, pi2, post2
    return langs, pi, post


def single(score: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """Of each document (its first row in score, at) whether one language is enough: no mixture's log-likelihood exceeds the sum
    of its sentences' best ones, so where that gains no more than the penalty the search of `mixture` ends with one."""
    best = np.add.reduceat(score, at, axis=0).max(1)
    return np.add.reduceat(score.max(1), at) - best <= penalty


def fit_on(df: DataFrame, id_col: str, text: str, label: str, sample_rows: int = 30_000, rounds: int = 3, names: list[str] = LANGUAGES, table: str = "") -> Languages:
    """Learns from the sample_rows labelled rows with the smallest hash of their id; the label as label_of gives it.

    names: the languages to tell apart; a label of another language counts as none, as labels may be wrong."""
    rows = df.where(F.col(label).isin(*names) & F.col(text).isNotNull())
    rows = rows.select(id_col, text, label).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).toPandas()
    texts, labels = rows[text].tolist(), rows[label].tolist()
    return stored(df.sparkSession, table, "langid", (sample_rows, rounds, tuple(names)), [*texts, None, *labels], lambda: Languages.train(texts, labels, rounds, names))


def detect(df: DataFrame, id_col: str, text: str, model: Languages, keep: list[str] | None = None, penalty: float = 10.0, chunk: int = 4000) -> DataFrame:
    """(id, kept columns, language, languages, share, confidence, segments): a row for each language of each text with words.

    languages is how many the text has.
    segments holds the stretches of that language: array<struct<start,stop,confidence>>, offsets in code points.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.table, model.names))
    keep = keep or []
    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}{kinds}, language string, languages int, share double, confidence double, segments array<struct<start:int,stop:int,confidence:double>>"

    def runs_of(places, sure) -> list[dict]:
        runs: list[dict] = []
        for (a, b), c in zip(places, sure):
            if runs and runs[-1]["stop"] == a:
                runs[-1] = {"start": runs[-1]["start"], "stop": b, "confidence": min(runs[-1]["confidence"], float(c))}
            else:
                runs.append({"start": a, "stop": b, "confidence": float(c)})
        return runs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Languages(*shared.value)
        for got in batches:
            for first in range(0, len(got), chunk):
                part = got.iloc[first : first + chunk]
                spans, pieces, rows = [], [], []
                for i, t in enumerate(part[text]):
                    if isinstance(t, str) and HAS_LETTER.search(NOISE.sub(" ", t) if MARKS.search(t) else t):
                        rows.append(i)
                        spans.append(sentences(t))
                        pieces += [t[a:b] for a, b in spans[-1]]
                out = []
                if rows:
                    once = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
                    score = m.score(list(once))[[once[p] for p in pieces]]
                    size = np.array([len(s) for s in spans])
                    at = np.cumsum(size) - size
                    alone, top = single(score, at, penalty), np.add.reduceat(score, at, axis=0).argmax(1)
                    # confidence of each sentence in its text's likeliest language
                    of = np.repeat(top, size)[:, None]
                    sure = 1.0 / np.exp(np.minimum(score - np.take_along_axis(score, of, 1), 80)).sum(1)
                    kept = list(part[[id_col, *keep]].itertuples(index=False, name=None))
                    for d, i in enumerate(rows):
                        a, s = at[d], spans[d]
                        if alone[d]:
                            c = sure[a : a + len(s)]
                            out.append((*kept[i], m.names[top[d]], 1, 1.0, float(c.mean()), runs_of(s, c)))
                            continue
                        mine_score = score[a : a + len(s)]
                        langs, pi, post = mixture(mine_score, penalty)
                        pick = post.argmax(1)
                        present = len(np.unique(pick))
                        for j, lang in enumerate(langs):
                            mine = np.flatnonzero(pick == j)
                            if len(mine):
                                full = mine_score[mine]
                                c = 1.0 / np.exp(np.minimum(full - full[:, [lang]], 80)).sum(1)
                                out.append((*kept[i], m.names[lang], present, float(pi[j]), float(c.mean()), runs_of([s[r] for r in mine], c)))
                yield pd.DataFrame(out, columns=[id_col, *keep, "language", "languages", "share", "confidence", "segments"])

    return spread(df.select(id_col, *keep, text)).mapInPandas(run, schema)
