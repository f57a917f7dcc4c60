"""Normalising, tokenising and path functions as Column expressions.

Words are runs of letters, digits and the underscore of any script: Java's ``\\w`` knows ASCII only.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import ADVANCED_STOP, GOODS_STOP, KEYWORD_STOP, MEANINGFUL_STOP, SUFFIXES, TRANSLIT_FROM, TRANSLIT_TO

WORD = r"[\p{L}\p{N}_]+"


def words_literal(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def no_words() -> Column:
    return F.array().cast("array<string>")


def normalize(text: Column) -> Column:
    """Lower case, anything but words and white space as a space, single spaces, none at the ends. Null: empty."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lower, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def keyword_list(text: Column, stop: Iterable[str] = KEYWORD_STOP) -> Column:
    """Words over two letters that aren't stop words, in order, repeats kept."""
    stop = words_literal(stop)
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1)), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def keywords(text: Column, stop: Iterable[str] = KEYWORD_STOP) -> Column:
    return F.array_distinct(keyword_list(text, stop))


def meaningful_words(normalized: Column) -> Column:
    """Of a normalised text, in order, repeats kept."""
    stop = words_literal(MEANINGFUL_STOP)
    return F.filter(F.split(normalized, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def batch_words(text: Column) -> Column:
    """Distinct meaningful words without those that any category of goods has."""
    goods = words_literal(GOODS_STOP)
    return F.array_distinct(F.filter(meaningful_words(normalize(text)), lambda w: ~F.array_contains(goods, w)))


def stem(word: Column) -> Column:
    """Without the first suffix that leaves more than two letters."""
    out = word
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        out = F.when(word.endswith(suffix) & (F.length(word) > n + 2), F.substring(word, F.lit(1), F.length(word) - n)).otherwise(out)
    return out


def advanced_keywords(text: Column) -> Column:
    """Distinct words over two letters without stop words, those over four each with its stem after it."""
    with_stem = lambda w: F.when(F.length(w) > 4, F.array(w, stem(w))).otherwise(F.array(w))
    return F.array_distinct(F.flatten(F.transform(keywords(text, ADVANCED_STOP), with_stem)))


def char_ngrams(text: Column, low: int = 2, high: int = 3) -> Column:
    """Distinct runs of letters over word ends: what isn't part of a word is taken out first."""
    packed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]", "")

    def of(n: int) -> Column:
        # sequence() would count down from 1 to 0
        return F.when(F.length(packed) >= n, F.transform(F.sequence(F.lit(1), F.length(packed) - (n - 1)), lambda i: F.substring(packed, i, F.lit(n)))).otherwise(no_words())

    return F.array_distinct(F.concat(*[of(n) for n in range(low, high + 1)]))


def word_ngrams(text: Column, low: int = 1, high: int = 3) -> Column:
    """Runs of words of a normalised text, joined by spaces; repeats kept."""
    tokens = F.regexp_extract_all(normalize(text), F.lit(f"({WORD})"), F.lit(1))

    def of(n: int) -> Column:
        return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(no_words())

    return F.concat(*[of(n) for n in range(low, high + 1)])


def transliterate(text: Column) -> Column:
    return F.translate(text, TRANSLIT_FROM, TRANSLIT_TO)


def path_ids(path: Column) -> Column:
    return F.split(path, ">")


def parent_of(ids: Column) -> Column:
    return F.when(F.size(ids) > 1, F.element_at(ids, -2))


def root_of(ids: Column) -> Column:
    return F.element_at(ids, 1)


def displayed(names: Column) -> Column:
    return F.array_join(names, " > ")


def path_words(display: Column) -> Column:
    """Distinct words between white space of a displayed path; its ``>`` counts as one."""
    return F.array_distinct(F.filter(F.split(F.lower(display), r"\s+"), lambda w: w != ""))


def duration(seconds: Column) -> Column:
    """HH:MM:SS, with as many hours as there are."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def hint_words(name: Column, hints: Mapping[str, list[str]]) -> Column:
    """The families of hints of which the name holds a member."""
    lower, found = F.lower(F.coalesce(name, F.lit(""))), no_words()
    for base, others in hints.items():
        any_of = lower.contains(base)
        for other in others:
            any_of = any_of | lower.contains(other)
        found = F.concat(found, F.when(any_of, words_literal([base, *others])).otherwise(no_words()))
    return F.array_distinct(found)
