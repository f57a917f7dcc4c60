"""The expressions of functions/text.py and functions/similarity.py in DuckDB's SQL."""

from __future__ import annotations

from ..functions.dictionaries import ADVANCED_STOP, KEYWORD_STOP, MEANINGFUL_STOP, SUFFIXES, TRANSLIT_FROM, TRANSLIT_TO

W = r"[\p{L}\p{N}_]+"


def words(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def normalize(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def keyword_list(x: str, stop=KEYWORD_STOP) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{W}'), lambda w: length(w) > 2 AND NOT list_contains({words(stop)}, w))"


def keywords(x: str, stop=KEYWORD_STOP) -> str:
    return f"list_distinct({keyword_list(x, stop)})"


def stem(w: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) > {len(s) + 2} THEN left({w}, length({w}) - {len(s)})" for s in SUFFIXES) + f" ELSE {w} END"


def advanced(x: str) -> str:
    own = keywords(x, ADVANCED_STOP)
    return f"list_distinct(list_concat({own}, list_transform(list_filter({own}, lambda w: length(w) > 4), lambda w: {stem('w')})))"


def meaningful(normalized: str) -> str:
    return f"list_filter(string_split({normalized}, ' '), lambda w: length(w) > 2 AND NOT list_contains({words(MEANINGFUL_STOP)}, w))"


def char_ngrams(x: str, low: int = 2, high: int = 3) -> str:
    packed = rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]', '', 'g')"
    parts = [f"list_transform(range(1, length({packed}) - {n} + 2), lambda i: substr({packed}, i, {n}))" for n in range(low, high + 1)]
    return f"list_distinct(list_concat({', '.join(parts)}))"


def word_ngrams(x: str, low: int = 1, high: int = 3) -> str:
    t = f"regexp_extract_all({normalize(x)}, '{W}')"
    parts = [f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))" for n in range(low, high + 1)]
    return f"list_concat({', '.join(parts)})"


def translit(x: str) -> str:
    return f"translate({x}, '{TRANSLIT_FROM}', '{TRANSLIT_TO}')"


def path_words(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> ''))"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE ELSE 0.0 END)"


def mapping(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {words(v)}" for k, v in table.items()) + "}"


def direct(a: str, b: str, compat: bool = False) -> str:
    tie = f" WHEN length({a}) = length({b}) THEN 1.0" if compat else ""
    return f"(CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < length({b}) AND contains({b}, {a}) THEN length({a}) / length({b})::DOUBLE WHEN length({a}) > length({b}) AND contains({a}, {b}) THEN length({b}) / length({a})::DOUBLE{tie} ELSE 0.0 END)"


def _of(table: dict, w: str) -> str:
    return f"coalesce(element_at({mapping(table)}, {w})[1], []::VARCHAR[])"


def synonyms(a: str, b: str, table: dict) -> str:
    each = f"CASE WHEN list_contains({b}, w) THEN 1.0 ELSE (CASE WHEN list_has_any({_of(table, 'w')}, {b}) THEN 0.9 ELSE 0.0 END) + (CASE WHEN len(list_filter({b}, lambda r: list_contains({_of(table, 'r')}, w))) > 0 THEN 0.9 ELSE 0.0 END) END"
    whole = f"array_to_string({a}, ' ')"
    return f"(CASE WHEN greatest(len({a}), len({b})) = 0 THEN 0.0 WHEN list_has_any({_of(table, whole)}, {b}) THEN 1.0 ELSE coalesce(list_sum(list_transform({a}, lambda w: ({each})::DOUBLE)), 0) / greatest(len({a}), len({b})) END)"


def basic(a: str, b: str, table: dict) -> str:
    each = f"CASE WHEN list_contains({b}, w) THEN 1.0 WHEN list_has_any({_of(table, 'w')}, {b}) OR len(list_filter({b}, lambda r: list_contains({_of(table, 'r')}, w))) > 0 THEN 0.9 ELSE 0.0 END"
    own = f"list_distinct({a})"
    return f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE list_sum(list_transform({own}, lambda w: ({each})::DOUBLE)) / len({own}) END)"


def partial(a: str, b: str) -> str:
    each = f"list_sum(list_transform({b}, lambda y: CASE WHEN length(x) >= 4 AND length(y) >= 4 AND left(x, 4) = left(y, 4) THEN 0.7::DOUBLE WHEN contains(x, y) OR contains(y, x) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE list_sum(list_transform({a}, lambda x: {each})) / greatest(len({a}), len({b})) END)"


def letter_bound(a: str, b: str) -> str:
    times = lambda s: f"(length({s}) - length(replace({s}, c, '')))"
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: least({times(a)}, {times(b)}))), 0) / (length({a}) + length({b})) END)"
