"""Model providers: embedding, generation and analysis behind plain functions.

A provider is built once per Python worker from its factory. The defaults need no model file: a hashed bag of
words embeds, keyword lookup analyses, an echo generates. They are stand-ins and say so in their name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM, MAX_TOKENS, TEMPERATURE = 384, 512, 0.7
CACHE_WORDS = 400_000


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """L2-normalised counts of lower-cased words in hashed places, built of SQL functions; null for a blank text."""
    from tessera.functions.text import tokens, trim_ws

    places = F.transform(tokens(text), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dim)).cast("int"))
    counts = F.aggregate(places, F.array_repeat(F.lit(0.0), dim), lambda acc, p: F.transform(acc, lambda x, i: x + F.when(i == p, 1.0).otherwise(0.0)))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(trim_ws(text) != "", F.transform(counts, lambda x: (x / length).cast("float")))


class Places(dict):
    """word -> hashed place, made when asked for."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = place = zlib.crc32(word.encode()) % self.dim
        return place


class HashedEmbedder:
    """The same vectors in numpy, for long texts and as the template of a provider."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.places = Places(dim)

    def embed(self, texts: list[str]) -> list[np.ndarray | None]:
        look = self.places.__getitem__
        out: list[np.ndarray | None] = []
        for t in texts:
            words = t.lower().split() if t else []
            if not words:
                out.append(None)
                continue
            v = np.bincount(np.fromiter(map(look, words), np.int64, len(words)), minlength=self.dim).astype(np.float64)
            out.append((v / np.sqrt((v * v).sum())).astype(np.float32))
        return out


_providers: dict[object, object] = {}


def provider(factory: Callable[[], object]):
    """One instance per worker and factory."""
    key = (getattr(factory, "__module__", ""), getattr(factory, "__qualname__", repr(factory)), repr(getattr(factory, "keywords", "")))
    if key not in _providers:
        _providers[key] = factory()
    return _providers[key]


def embedding_udf(factory: Callable[[], object] = HashedEmbedder):
    """Pandas UDF STRING -> ARRAY<FLOAT>, batch by batch; blank texts give null."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(provider(factory).embed(texts.fillna("").tolist()))

    return embed


class EchoGenerator:
    """Gives the prompt's last line back, cut to max_tokens words."""

    def generate(self, prompts: list[str], max_tokens: int, temperature: float) -> list[str | None]:
        return [" ".join(p.strip().splitlines()[-1].split()[:max_tokens]) if p and p.strip() else None for p in prompts]


def generation_udf(factory: Callable[[], object] = EchoGenerator, max_tokens: int = MAX_TOKENS, temperature: float = TEMPERATURE):
    @F.pandas_udf("string")
    def generate(prompts: pd.Series) -> pd.Series:
        return pd.Series(provider(factory).generate(prompts.fillna("").tolist(), max_tokens, temperature), dtype=object)

    return generate


#: First of these verbs in a text is its action.
ACTIONS = ["explain", "write", "debug", "compare", "translate", "summarize", "test", "optimize"]


def keyword_analysis(words: Column, text: Column, domains: list[str]) -> Column:
    """STRUCT<action, domain, topic> by lookup: the first known verb, the first known domain, the longest word."""
    first = lambda known, default: F.coalesce(F.try_element_at(F.filter(words, lambda w: w.isin(known)), F.lit(1)), F.lit(default))
    longest = F.reduce(words, F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
    return F.struct(first(ACTIONS, "explain").alias("action"), first(domains, "general").alias("domain"), longest.alias("topic"))
