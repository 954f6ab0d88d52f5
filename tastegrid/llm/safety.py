"""Scores for abusive, hateful or sexual content, by a factorization machine over hashed terms.

A document's score is that of its worst sentence. Sentences are brought to a plain form first (invisible characters,
look-alike letters, digits for letters, spaced and stretched words), and each word counts also as its consonants, so that
masked vowels match. Pairwise interactions tell an insult at a person or group from the same word about food or oneself.

The machine is fitted on the driver to a bounded sample of labelled rows (`sample_rows`, those of smallest hash of their
id). Labels are given to whole documents and may be wrong: in rounds, the worst sentence of each unsafe document becomes
the unsafe one, and unsafe documents in which the fit of other documents finds nothing are left out. Then confident
sentences of a bounded sample of unlabelled rows join as training material.

Defined results: null, empty or wordless texts score 0; equal texts score equally; rows labelled both ways count for
neither; an empty table or one without labels of both kinds scores 0 throughout. Texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.langid import NOISE, sentences
from tastegrid.llm.models import stored
from tastegrid.session import spread

BUCKETS = 1 << 16

# fixed values: Cyrillic and Greek letters that look like Latin ones
LOOKALIKES = dict(zip("авекмнорстухіјѕԁһӏԛԝαβεικμνορτυχ", "abekmhopctyxijsdhlqwabeikmvoptux"))
# fixed values: digits and signs written for letters
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e"}
HIDDEN = re.compile("[­​-‏⁠-⁤﻿᠎]")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ऀ-৿]{0,2}[ .\-_·]){3,}[^\W\d_][ऀ-৿]{0,2}(?![^\W_])")
TOKEN = re.compile(r"[^\W_](?:[\w*@$!€'’ऀ-৿-]*[\w*@$ऀ-৿])?")
GREEK_CYRILLIC = re.compile("[\u0370-\u052f]")
NUMBERY = re.compile(r"\d[\d.,:/-]*(?:st|nd|rd|th|am|pm|k|x)?$")


def _plain(t: str) -> str:
    """A token in plain form."""
    if NUMBERY.fullmatch(t):
        t = "0"
    elif not t.isalpha():
        if any(c.isalpha() for c in t):
            t = "".join(LEET.get(c, c) for c in t)
        t = re.sub(r"['’\-]", "", t)
    t = re.sub(r"(.)\1{2,}", r"\1", t)
    return t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f")


def _raw_tokens(sentence: str) -> list[str]:
    s = NOISE.sub(" ", HIDDEN.sub("", sentence))
    if not s.isascii():
        s = HIDDEN.sub("", unicodedata.normalize("NFKC", s))
    s = s.lower()
    if not s.isascii() and GREEK_CYRILLIC.search(s):
        s = "".join(LOOKALIKES.get(c, c) for c in s)
    return TOKEN.findall(SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m[0]), s))


def plain_words(sentence: str) -> list[str]:
    """The words of a sentence in plain form; masked letters stay as *."""
    return [w for w in map(_plain, _raw_tokens(sentence)) if w]


def skeleton(word: str) -> str:
    """The word without vowels, vowel signs and masked letters."""
    return "".join(c for c in word if c not in "aeiouy*" and unicodedata.category(c)[0] != "M")


@lru_cache(maxsize=1 << 16)
def _token_terms(token: str) -> tuple[int, ...]:
    w = _plain(token)
    if not w:
        return ()
    masked, bones = "*" in w, skeleton(w)
    found = [] if masked else ["w:" + w]
    if (masked or len(w) > 3) and len(bones) > 1:
        found.append("k:" + bones)
    return tuple(1 + zlib.crc32(f.encode("utf-8", "replace")) % (BUCKETS - 1) for f in found)


def terms(sentence: str) -> list[int]:
    """Hashed terms, each once; 0 is kept for padding."""
    return list(dict.fromkeys(chain.from_iterable(map(_token_terms, _raw_tokens(sentence)))))


class FactorizationMachine:
    def __init__(self, rank: int = 8, seed: int = 7) -> None:
        self.b = 0.0
        self.w = np.zeros(BUCKETS, np.float32)
        self.v = (np.random.default_rng(seed).normal(size=(BUCKETS, rank)) * 0.03).astype(np.float32)
        self.v[0] = 0

    def fit(self, rows: list[list[int]], y: np.ndarray, weight: np.ndarray, epochs: int = 18, batch: int = 128, rate: float = 0.2, l2: float = 3e-4, seed: int = 7) -> None:
        """Adagrad on the weighted logistic loss; y is 0 or 1. Rows lie end to end, so that they may be of any length."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), np.int32, int(size.sum()))
        begin, used = np.cumsum(size) - size, np.flatnonzero(size)
        rank = self.v.shape[1]
        r = np.random.default_rng(seed)
        gw, gv, gb = np.full(BUCKETS, 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = r.permutation(used)
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                n = size[at]
                first = np.cumsum(n) - n
                terms_at = flat[np.repeat(begin[at] - first, n) + np.arange(int(n.sum()))]
                scale = (1.0 / np.sqrt(n)).astype(np.float32)
                v = self.v[terms_at]
                s = np.add.reduceat(v, first, axis=0)
                z = self.b + np.add.reduceat(self.w[terms_at], first) * scale + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), first)) * scale**2
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at] / len(at) * 16).astype(np.float32)
                ids, back = np.unique(terms_at, return_inverse=True)
                each = (np.repeat(s, n, axis=0) - v) * np.repeat(g * scale**2, n)[:, None]
                dw = np.bincount(back, np.repeat(g * scale, n), len(ids)).astype(np.float32)
                dv = np.bincount((back[:, None] * rank + np.arange(rank)).ravel(), each.ravel(), len(ids) * rank).reshape(-1, rank).astype(np.float32)
                dw += l2 * self.w[ids]
                dv += l2 * self.v[ids]
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= rate * 0.5 * dv / np.sqrt(gv[ids])
                gb += float(g.sum()) ** 2
                self.b -= rate * float(g.sum()) / gb**0.5

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """Scores of rows of any length: sums are taken over a row's terms end to end, so nothing is padded or cut."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        z = np.full(len(rows), self.b, np.float64)
        full = np.flatnonzero(size)
        if len(full):
            flat = np.fromiter(chain.from_iterable(rows), np.int32, int(size.sum()))
            begin = (np.cumsum(size) - size)[full]
            v = self.v[flat]
            s, w, q = np.add.reduceat(v, begin, axis=0), np.add.reduceat(self.w[flat], begin), np.add.reduceat((v * v).sum(1), begin)
            scale = 1.0 / np.sqrt(size[full])
            z[full] += w * scale + 0.5 * ((s * s).sum(1) - q) * scale**2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _split(texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
    rows, owner = [], []
    for i, t in enumerate(texts):
        for a, b in sentences(t):
            f = terms(t[a:b])
            if f:
                rows.append(f)
                owner.append(i)
    return rows, np.array(owner, dtype=np.int64)


def fit(texts: list[str], labels: list[int], more: list[str], rounds: int = 2, folds: int = 3, seed: int = 7) -> FactorizationMachine | None:
    """Fits to labelled documents (1 unsafe, 0 safe) and then to confident sentences of unlabelled ones."""
    y = np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return None
    rows, owner = _split(texts)
    ys = y[owner]
    size = np.bincount(owner, minlength=len(texts))
    fold = np.array([zlib.crc32(t.encode()) % folds for t in texts])[owner]
    target = ys.astype(float)
    weight = np.where(ys == 1, 1.0 / size[owner], 1.0)
    for k in range(rounds):
        out = np.zeros(len(rows))
        for f in range(folds):
            m = FactorizationMachine(seed=seed + f)
            on, off = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            m.fit([rows[i] for i in on], target[on], weight[on], seed=seed)
            out[off] = m.score([rows[i] for i in off])
        worst = np.full(len(texts), -1.0)
        np.maximum.at(worst, owner, out)
        first = (out == worst[owner])
        unsafe = ys == 1
        target = np.where(unsafe & first, 1.0, 0.0)
        weight = np.where(unsafe & ~first, 0.3, 1.0)
        # what the other folds contradict is taken for a slip of the annotator
        weight[unsafe & (worst[owner] < (0.04, 0.08, 0.1)[min(k, 2)])] = 0.0
    model = FactorizationMachine(seed=seed)
    model.fit(rows, target, weight, seed=seed)
    if more:
        rows2, _ = _split(more)
        rows2 = [list(r) for r in dict.fromkeys(map(tuple, rows2))]
        for high in (0.85, 0.75, 0.65):
            p = model.score(rows2)
            sure = np.flatnonzero((p > high) | (p < 0.05))
            ts, ws = np.concatenate([target, (p[sure] > 0.5).astype(float)]), np.concatenate([weight, np.full(len(sure), 0.5)])
            model = FactorizationMachine(seed=seed)
            model.fit(rows + [rows2[i] for i in sure], ts, ws, epochs=8, seed=seed)
    return model


def fit_on(df: DataFrame, labels: DataFrame, id_col: str, text: str, sample_rows: int = 60_000, unlabelled_rows: int = 15_000, table: str = "") -> FactorizationMachine | None:
    """labels: (id, label safe or unsafe). Both samples are the rows with the smallest hash of their id; unlabelled_rows bounds
    what joins the labelled rows as training material, every row is scored."""
    given = labels.groupBy(id_col).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo = hi and lo in ('safe', 'unsafe')")
    rows = df.select(id_col, text).join(given, id_col).where(F.col(text).isNotNull())
    rows = rows.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).select(text, F.col("lo")).toPandas()
    more = df.select(id_col, text).where(F.col(text).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(unlabelled_rows).toPandas()[text].tolist()
    texts, y = rows[text].tolist(), [int(v == "unsafe") for v in rows["lo"]]
    return stored(df.sparkSession, table, "safety", (sample_rows, unlabelled_rows), [*texts, None, *y, None, *more], lambda: fit(texts, y, more))


def score_texts(df: DataFrame, id_col: str, text: str, model: FactorizationMachine | None, keep: list[str] | None = None, chunk: int = 2000) -> DataFrame:
    """(id, kept columns, score, start, stop): the score and place of each text's worst sentence; sentences count with all their terms."""
    keep = keep or []
    shared = df.sparkSession.sparkContext.broadcast(None if model is None else (model.b, model.w, model.v))
    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}{kinds}, score double, start int, stop int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = None
        if shared.value is not None:
            m = FactorizationMachine(rank=1)
            m.b, m.w, m.v = shared.value
        for got in batches:
            for a in range(0, len(got), chunk):
                part = got.iloc[a : a + chunk]
                n = len(part)
                rows, owner, where = [], [], []
                for i, t in enumerate(part[text]):
                    if isinstance(t, str) and m is not None:
                        for s, e in sentences(t):
                            if f := terms(t[s:e]):
                                rows.append(f)
                                owner.append(i)
                                where.append((s, e))
                best, at = np.zeros(n), np.zeros((n, 2), np.int32)
                if rows:
                    score = m.score(rows)
                    order = np.argsort(score, kind="stable")
                    owners = np.array(owner)[order]
                    best[owners] = score[order]
                    at[owners] = np.array(where, dtype=np.int32)[order]
                cols = {id_col: part[id_col], **{c: part[c] for c in keep}}
                yield pd.DataFrame(cols | {"score": best, "start": at[:, 0], "stop": at[:, 1]})

    return spread(df.select(id_col, *keep, text)).mapInPandas(run, schema)
