"""Similarity scores as Column expressions; only the ratio of longest matching blocks runs in Python."""

from __future__ import annotations

from collections.abc import Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .dictionaries import BASIC_SYNONYMS, SYNONYMS
from .text import no_words, words_literal


@F.pandas_udf(DoubleType())
def _block_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    matcher, last, out = SequenceMatcher(None), None, []
    for a, b in zip(first, second, strict=True):
        if b != last:  # the second string's index is kept while it stays the same
            matcher.set_seq2(b)
            last = b
        matcher.set_seq1(a)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def ratio(first: Column, second: Column) -> Column:
    """Twice the letters in matching blocks over all letters. Not symmetric; two empty strings: 1."""
    return _block_ratio(F.coalesce(first, F.lit("")), F.coalesce(second, F.lit("")))


def length_bound(a: Column, b: Column) -> Column:
    """No less than the ratio, by lengths alone."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2 * F.least(F.length(a), F.length(b)) / both)


def letter_bound(a: Column, b: Column) -> Column:
    """No less than the ratio, and no more than length_bound(): letters that both have, in any order."""
    both = F.length(a) + F.length(b)
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    # the letters of a string that are c: what is missing when c is taken out
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    shared = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    return F.when(both == 0, F.lit(1.0)).otherwise(2 * shared / both)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """jaccard() of arrays without repeats: the union's size follows from what both share."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """What both sets share over the larger one's size."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def direct(a: Column, b: Column, compat: bool = False) -> Column:
    """1 if equal; the lengths' quotient if one holds the other; else 0.

    compat: strings of equal length count as holding each other, empty ones too."""
    la, lb = F.length(a), F.length(b)
    held = F.when((la < lb) & b.contains(a), la / lb).when((la > lb) & a.contains(b), lb / la)
    if compat:
        held = held.when(la == lb, F.lit(1.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(held, F.lit(0.0)))


def _table(words: Mapping[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in words.items() for x in (F.lit(k), words_literal(v))])


def synonyms(mine: Column, theirs: Column, table: Mapping[str, list[str]] = SYNONYMS) -> Column:
    """Word by word: 1 for a word that both have, else 0.9 for a synonym and 0.9 more for one the
    other way round; over the larger number of words. A whole phrase with a synonym there: 1."""
    known = _table(table)
    of = lambda w: F.coalesce(F.element_at(known, w), no_words())
    most = F.greatest(F.size(mine), F.size(theirs))
    each = lambda w: F.when(F.array_contains(theirs, w), F.lit(1.0)).otherwise(
        F.when(F.arrays_overlap(of(w), theirs), 0.9).otherwise(0.0) + F.when(F.exists(theirs, lambda r: F.array_contains(of(r), w)), 0.9).otherwise(0.0)
    )
    total = F.aggregate(mine, F.lit(0.0), lambda n, w: n + each(w))
    phrase = F.arrays_overlap(of(F.array_join(mine, " ")), theirs)
    return F.when(most == 0, F.lit(0.0)).when(phrase, F.lit(1.0)).otherwise(total / most)


def basic_synonyms(mine: Column, theirs: Column, table: Mapping[str, list[str]] = BASIC_SYNONYMS) -> Column:
    """Over the distinct words of the first text only: 1 for a word of both, 0.9 for a synonym in either direction."""
    known = _table(table)
    of = lambda w: F.coalesce(F.element_at(known, w), no_words())
    own, other = F.array_distinct(mine), F.array_distinct(theirs)
    each = lambda w: F.when(F.array_contains(other, w), F.lit(1.0)).when(F.arrays_overlap(of(w), other) | F.exists(other, lambda r: F.array_contains(of(r), w)), 0.9).otherwise(0.0)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.aggregate(own, F.lit(0.0), lambda n, w: n + each(w)) / F.size(own))


def partial_words(mine: Column, theirs: Column) -> Column:
    """Over all pairs of words: 0.7 for four equal first letters, else 0.8 if one holds the other."""
    pair = lambda a, b: F.when((F.length(a) >= 4) & (F.length(b) >= 4) & (F.left(a, F.lit(4)) == F.left(b, F.lit(4))), 0.7).when(a.contains(b) | b.contains(a), 0.8).otherwise(0.0)
    total = F.aggregate(mine, F.lit(0.0), lambda n, a: n + F.aggregate(theirs, F.lit(0.0), lambda m, b: m + pair(a, b)))
    return F.when((F.size(mine) == 0) | (F.size(theirs) == 0), F.lit(0.0)).otherwise(total / F.greatest(F.size(mine), F.size(theirs)))


def confidence(value: Column) -> Column:
    """Any text or number as a confidence from 0 to 1; what is none, or null, is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))
