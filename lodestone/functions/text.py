"""Tokens, stems, identifiers and query understanding, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word endings in the order in which they are tried; the first that leaves three characters is cut.
SUFFIXES = "ами ями ого ему ими ому ах ях ов ев ей ий ый ая ое ые у а е и о ы ь ю я".split()
#: Query words that carry no content.
STOP_WORDS = "и в во на по к с со из для о об от".split()
#: Kinds of entities that do something, and kinds that only are.
EXECUTABLE_KINDS, STATIC_KINDS = "method function constructor procedure".split(), "property type enum topic page".split()
#: Beginnings of words for splitting, converting and joining.
ACTION_STEMS = "раздел разбив преобраз конверт соедин подстав объедин split concat".split()
TOKEN_PATTERN, CAPITALISED_PATTERN = "[a-zа-яё0-9]+", "[А-ЯЁA-Z][а-яёa-z]*"
STEM_PATTERN = f"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column) -> Column:
    """Lower-cased runs of Latin or Cyrillic letters and digits, in order, repeats included; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0), F.array().cast("array<string>"))


def normalized(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def stem(token: Column) -> Column:
    """Every ending is Cyrillic, so only a token whose last letter is (beyond z) is looked at."""
    return F.when(F.substring(token, -1, 1) > "z", F.regexp_replace(token, STEM_PATTERN, "$1")).otherwise(token)


def stems(text: Column) -> Column:
    """The stem of every token: what the lexical index is made of."""
    return F.transform(tokens(text), stem)


def split_identifier(name: Column) -> Column:
    """Words of a CamelCase or dotted name, lower-cased. A part without a capital stays whole; else only its
    capitalised words stay."""
    parts = F.filter(F.split(F.trim(name), r"[.\s]+"), lambda part: part != "")
    words = F.transform(parts, lambda part: F.regexp_extract_all(part, F.lit(CAPITALISED_PATTERN), 0))
    chosen = F.zip_with(parts, words, lambda part, found: F.when(F.size(found) > 0, found).otherwise(F.array(part)))
    return F.lower(F.array_join(F.flatten(chosen), " "))


def _overlap(a: Column, b: Column) -> Column:
    return (F.length(a) >= 3) & (F.length(b) >= 3) & (a.startswith(b) | b.startswith(a))


def related(a: Column, b: Column) -> Column:
    """Whether two tokens, or their stems, are equal or one begins the other (three characters at least)."""
    return related_stems(stem(a), stem(b))


def related_stems(a: Column, b: Column) -> Column:
    """``related`` for the stems of two tokens. A stem begins its token and keeps three characters of it, so tokens that are equal, or of which
    one begins the other, have stems like that too."""
    return (a == b) | _overlap(a, b)


def valued(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once for a row, however often ``then`` uses it, within lambdas too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _content(token: Column) -> Column:
    return (F.length(stem(token)) >= 3) & ~stem(token).isin(STOP_WORDS)


def content_stems(query: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tokens(query), _content), stem))


def is_transformation(query: Column) -> Column:
    """Asks to turn one thing into another."""
    return F.array_contains(tokens(query), "в") & (F.size(content_stems(query)) >= 2)


def expanded_query(query: Column) -> Column:
    """A transformation query with its paraphrases; any other query as it is."""
    content = F.filter(tokens(query), _content)
    source, target = F.get(content, F.lit(0)), F.element_at(content, -1)
    text_to_array = stem(source).startswith("строк") & stem(target).startswith("масс")
    paraphrased = F.concat_ws(". ", query, F.concat(F.lit("преобразовать "), source, F.lit(" в "), target), F.concat(F.lit("получить "), target, F.lit(" из "), source), F.when(text_to_array, F.lit("разделить строку")))
    return F.when(is_transformation(query) & (F.size(content) >= 2), paraphrased).otherwise(query)


def matched_terms(query: Column, text: Column) -> Column:
    """Distinct query tokens that the text has, in query order."""
    return F.array_intersect(tokens(query), tokens(text))


def semantic_terms(query: Column, text: Column, most: int = 8) -> Column:
    """The first distinct tokens of a text whose stem fits a content stem of the query (or an action, if it asks for one)."""
    wanted, acting = content_stems(query), is_transformation(query)

    def fits(token: Column) -> Column:
        own = stem(token)
        asked = F.exists(wanted, lambda w: own.startswith(w) | w.startswith(own))
        return (F.length(own) >= 3) & (asked | (acting & F.exists(strings(ACTION_STEMS), lambda a: own.startswith(a))))

    found = F.slice(F.array_distinct(F.filter(tokens(text), fits)), 1, most)
    return F.when(F.size(wanted) > 0, found).otherwise(F.array().cast("array<string>"))


def first_position(text: Column, terms: Column) -> Column:
    """Where the first of the terms begins (from 0, case ignored); null if none occurs."""
    places = F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.position(F.lower(t), F.lower(text)) - 1)
    return F.array_min(F.filter(places, lambda p: p >= 0))


def excerpt(text: Column, terms: Column, size: int = 500) -> Column:
    """struct(excerpt, begin, end): a window of ``size`` characters around the first term, with dots where it cuts."""
    text = F.coalesce(text, F.lit(""))
    n, at = F.length(text), first_position(text, terms)
    end = F.least(n, F.greatest(F.lit(0), at - size // 2) + size)
    begin = F.greatest(F.lit(0), end - size)
    window = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(text, begin + 1, end - begin), F.when(end < n, "...").otherwise(""))
    whole, head = n <= size, at.isNull()
    shown = F.when(whole, text).when(head, F.concat(F.substring(text, F.lit(1), F.lit(size)), F.lit("..."))).otherwise(window)
    return F.struct(
        shown.alias("excerpt"),
        F.when(whole | head, 0).otherwise(begin).cast("int").alias("begin"),
        F.when(whole, n).when(head, size).otherwise(end).cast("int").alias("end"),
    )


def short_hash(content: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def highlighted(text: Column, terms: list[str]) -> Column:
    """The text with every occurrence of a term, longest first and case ignored, in <mark> tags."""
    import re

    words = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    return F.regexp_replace(text, f"(?iu)({'|'.join(map(re.escape, words))})", "<mark>$1</mark>") if words else text
