"""Text expressions: identifier-aware tokens, token sets and token counts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessergraph.functions.stemmer import stem

_PIECE = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"


def split_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits with camel case split, then those runs of the unsplit text that are
    not among them."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.regexp_extract_all(F.lower(spaced), F.lit("([a-z0-9]+)"), 1)
    return F.concat(parts, F.array_except(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), parts))


def _stemmed(tokens) -> list[str]:
    out: list[str] = []
    for t in tokens if tokens is not None else ():
        s = stem(t) or t
        if not out or out[-1] != s:
            out.append(s)
    return out


@F.pandas_udf(ArrayType(StringType()))
def _stem_all(tokens: pd.Series) -> pd.Series:
    return tokens.map(_stemmed)


def tokens(text: Column, stemmed: bool = True) -> Column:
    """Tokens in order; stemmed ones without immediate repeats, as stemming makes neighbours equal."""
    found = split_tokens(F.coalesce(text, F.lit("")))
    return _stem_all(found) if stemmed else found


def tokenize(text: str, stemmed: bool = True) -> list[str]:
    """The same for one Python string."""
    import re

    spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", text))
    parts = re.findall("[a-z0-9]+", spaced.lower())
    known = set(parts)
    for whole in re.findall("[a-z0-9]+", text.lower()):
        if whole not in known:
            known.add(whole)
            parts.append(whole)
    return _stemmed(parts) if stemmed else parts


def word_set(text: Column) -> Column:
    """Distinct white-space separated words, lower case, underscores taken as spaces."""
    return F.array_distinct(F.filter(F.split(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), r"\s+"), lambda x: x != ""))


def similarity(words_a: Column, words_b: Column, community_a: Column, community_b: Column) -> Column:
    """Half for sharing a known community, half the Jaccard similarity of the word sets (0 if one is empty)."""
    union = F.size(F.array_union(words_a, words_b))
    jaccard = F.when((F.size(words_a) > 0) & (F.size(words_b) > 0), F.size(F.array_intersect(words_a, words_b)) / union).otherwise(0.0)
    return F.when(community_a == community_b, 0.5).otherwise(0.0) + 0.5 * jaccard


def estimated_tokens(text: Column) -> Column:
    """Runs of letters and digits, and every other mark: a token count that needs no vocabulary."""
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.regexp_count(text, F.lit(_PIECE))).cast("int")


def bpe_tokens(encoding: str) -> Callable[[Column], Column]:
    """Exact counts with a tiktoken encoding, where its vocabulary is at hand; an unknown name is taken as a model's."""
    import tiktoken

    try:
        name = tiktoken.get_encoding(encoding).name
    except ValueError:
        name = tiktoken.encoding_for_model(encoding).name

    @F.pandas_udf("int")
    def count(text: pd.Series) -> pd.Series:
        enc = tiktoken.get_encoding(name)
        return text.map(lambda t: len(enc.encode(t, disallowed_special=())) if t else 0)

    return count


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [0, 1]; 0 for a zero vector; the longer vector is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    a, b = (F.slice(x.cast("array<double>"), F.lit(1), F.greatest(n, F.lit(0))) for x in (a, b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norms))).otherwise(0.0)
