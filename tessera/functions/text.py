"""Tokenizers as array expressions."""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_TERM = 64
#: What parts terms, for Spark's and for Python's expressions.
BETWEEN = r"[^\p{L}\p{N}_]+"


def parts(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores; the first and the last may be empty."""
    return F.split(F.lower(text), BETWEEN)


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, of 1 to 64 bytes."""
    return F.filter(parts(text), lambda t: F.octet_length(t).between(1, LONGEST_TERM))


def query_terms(query: str) -> list[str]:
    """The same of a query's text, in order, repeats included."""
    return [t for t in regex.split(BETWEEN, query.lower()) if 1 <= len(t.encode()) <= LONGEST_TERM]


#: Tokenizers by name, from a text column to an array of terms: `register` adds to them.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {}


def register(name: str, tokenizer: Callable[[Column], Column]) -> None:
    """Adds a tokenizer, or puts another in its place; the name's case doesn't matter."""
    TOKENIZERS[name.lower()] = tokenizer


def tokenize(text: Column, tokenizer: str = "whitespace") -> Column:
    if tokenizer.lower() not in TOKENIZERS:
        raise ValueError(f"no tokenizer {tokenizer!r}; known: {', '.join(sorted(TOKENIZERS))}")
    return TOKENIZERS[tokenizer.lower()](text)


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams; a shorter text is one gram."""
    low, size = F.lower(text), F.char_length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(grams)


def contains_all(text: Column, query: str) -> Column:
    """Every white-space separated term of the query is a substring, whatever its case."""
    found = F.lit(True)
    for term in query.lower().split():
        found = found & F.contains(F.lower(text), F.lit(term))
    return found


def dictionary_terms(text: Column, words: list[str], longest: int | None = None) -> Column:
    """Terms of text that isn't written with spaces: from the left, the longest of the dictionary's words that stands there,
    else one character; runs of Latin letters and digits stay whole. White space and marks part terms."""
    known = sorted({w.lower() for w in words}, key=lambda w: (-len(w), w))
    known = [w for w in known if longest is None or len(w) <= longest]
    each = [*(regex.escape(w) for w in known), r"[a-z0-9_]+", r"[\p{L}\p{N}]"]
    return F.regexp_extract_all(F.lower(text), F.lit("(" + "|".join(each) + ")"), F.lit(1))


register("whitespace", terms)
register("ngram2", lambda text: ngrams(text, 2))
register("ngram3", lambda text: ngrams(text, 3))
