"""Sizes of texts in tokens of a public tokenizer; its files' folder is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tastegrid.session import spread

TOKENIZERS = os.environ.get("TASTEGRID_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: fixed value: how that vocabulary cuts a text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file of ranks, loaded once in each worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(df: DataFrame, id_col: str, text: str, keep: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, kept columns, tokens): whole texts; null counts as empty; lone surrogates count as their replacement."""
    path = os.path.join(folder, vocabulary)
    kinds = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for got in batches:
            sizes = [len(t.encode_ordinary(x)) if isinstance(x, str) else 0 for x in got[text]]
            yield pd.DataFrame({id_col: got[id_col], **{c: got[c] for c in keep}, "tokens": sizes})

    return spread(df.select(id_col, *keep, text)).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}{kinds}, tokens long")
