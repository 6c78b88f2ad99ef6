"""Enrichment of texts: language, sentiment, entities and an embedding, by a provider that can be exchanged."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memoriq.functions.text import ACRONYM, ACRONYM_NOISE, words

#: Frequent short words by which a language shows.
LANGUAGE_WORDS = {
    "en": "the and of to in is was with for that it on".split(),
    "de": "der die das und ist mit nicht ein eine für auf den".split(),
    "es": "el la los que y en con por una del para se".split(),
    "fr": "le les des et est une dans pour que pas sur avec".split(),
}
POSITIVE = "good great happy pleased proud relieved hopeful calm love nice win thanks better best".split()
NEGATIVE = "bad sad angry annoyed worried bored broken lost fail failed worse worst hate late sorry".split()
NAME_RUN = r"(?<![\p{L}\p{M}\p{N}_])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)(?![\p{L}\p{M}\p{N}_])"


class Enricher(Protocol):
    """What a provider offers: columns from a text column. `dim` 0 means that it can't embed."""

    profile: str
    backend: str
    dim: int

    def language(self, text: Column) -> Column: ...
    def sentiment(self, text: Column) -> Column: ...
    def entities(self, text: Column) -> Column: ...
    def embedding(self, text: Column) -> Column: ...


def _count(tokens: Column, known: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(known)))


@dataclass(frozen=True)
class WordEnricher:
    """The built-in provider: word lists, capital runs, and hashed character trigrams of unit length as embedding."""

    profile: str = "trigram-256"
    backend: str = "hash"
    dim: int = 256

    def language(self, text: Column) -> Column:
        t = words(text)
        scores = F.array(*[F.struct(_count(t, w).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("l")) for i, (k, w) in enumerate(LANGUAGE_WORDS.items())])
        best = F.array_max(scores)
        return F.when(best["n"] > 0, best["l"])

    def sentiment(self, text: Column) -> Column:
        """Of the first paragraph, -1 to 1; without any word of feeling 0."""
        t = words(F.substring_index(text, "\n\n", 1))
        up, down = _count(t, POSITIVE), _count(t, NEGATIVE)
        return F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0)

    def entities(self, text: Column) -> Column:
        """array<struct<value, entity_type>>: capital runs as Acronym, runs of capitalised words as Other."""
        short = F.filter(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(1)), lambda a: ~a.isin(ACRONYM_NOISE))
        long = F.regexp_extract_all(text, F.lit(NAME_RUN), F.lit(1))
        typed = lambda a, kind: F.transform(F.array_distinct(a), lambda v: F.struct(v.alias("value"), F.lit(kind).alias("entity_type")))
        return F.concat(typed(long, "Other"), typed(short, "Acronym"))

    def embedding(self, text: Column) -> Column:
        dim = self.dim

        def run(texts: pd.Series) -> pd.Series:
            import numpy as np
            import xxhash

            out = []
            for t in texts:
                v = np.zeros(dim, np.float32)
                t = f"  {(t or '').lower()} "
                for i in range(len(t) - 2):
                    h = xxhash.xxh32_intdigest(t[i : i + 3])
                    v[h % dim] += 1 if h >> 31 else -1
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            return pd.Series(out, dtype=object)

        return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


def first_able(*providers: Enricher) -> Enricher:
    """The first provider that can embed, else the last (texts then have no embedding)."""
    return next((p for p in providers if p.dim > 0), providers[-1])


def enriched(drafts: DataFrame, provider: Enricher, text_col: str = "text") -> DataFrame:
    t = F.col(text_col)
    return drafts.withColumns(
        {
            "language": provider.language(t),
            "sentiment": F.coalesce(provider.sentiment(t), F.lit(0.0)),
            "found": provider.entities(t),
            "embedding": provider.embedding(t) if provider.dim else F.lit(None).cast("array<float>"),
            "embedding_backend": F.lit(provider.backend),
            "embedding_profile": F.lit(provider.profile),
            "embedding_dim": F.lit(provider.dim),
        }
    )
