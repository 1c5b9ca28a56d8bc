"""Text functions as Spark columns, and their SQL twins for checks."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the text functions.
NUMBERS = r"(\d+[:., ]?)+"
MICROSYNTAX = r"/(by|cc|for|tip|thx|ty|ht|oh)"
RT = r"^/?RT:?\s*:?|\s/?RT:?\s*:?|\(RT:?.*\)"
VIA = r"^/?via:?\s*|\s/?via:?\s*|\(via:?.*\)|\[via:?.*\]"
#: A link with a scheme, or a bare host with a path; a mention, maybe of a list; a hashtag with a letter.
URL = r"(?:https?://[A-Za-z0-9._~-]+(?:/[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]*)?|(?:[A-Za-z0-9-]+[.])+(?:com|org|net|edu|gov|co|ly|gl|me|tv|uk|de|fr|es)/[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+)"
MENTION = r"[@＠][A-Za-z0-9_]+(?:/[A-Za-z][A-Za-z0-9_-]*)?"
HASHTAG = r"[#＃][\p{L}\p{N}_]*[\p{L}_][\p{L}\p{N}_]*"


def strip_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBERS, " ")


def strip_microsyntax(c: Column) -> Column:
    return F.regexp_replace(c, MICROSYNTAX, " ")


def strip_rt(c: Column) -> Column:
    return F.regexp_replace(c, RT, " ")


def strip_via(c: Column) -> Column:
    return F.regexp_replace(c, VIA, " ")


def strip_patterns(c: Column) -> Column:
    return strip_via(strip_rt(strip_microsyntax(c)))


def strip_nonalnum(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{Nd}]", "")


def url_decode(c: Column) -> Column:
    """A request's text without its escapes; null if they are malformed."""
    return F.try_url_decode(c)


def extract_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(URL), F.lit(0))


def abbreviate(c: Column, width: int = 500) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def stop_apply(c: Column, words: frozenset[str]) -> Column:
    """Words between blanks that aren't stop words, joined by blanks."""
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~w.isin(*sorted(words))), " ")


def entity_type(c: Column) -> Column:
    full = lambda p: c.rlike(f"^(?:{p})$")
    return F.when(full(URL), F.lit("url")).when(full(MENTION), F.lit("mention")).when(full(HASHTAG), F.lit("hashtag")).otherwise(F.lit("none"))


def count_of(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _joined(c: Column, pattern: str, swapped: Column) -> Column:
    """A text whose matches of a pattern (that matches no empty string) are exchanged for as many others."""
    return F.array_join(F.zip_with(F.split(c, pattern, -1), swapped, lambda kept, new: F.concat(kept, F.coalesce(new, F.lit("")))), "")


def _blank(pattern: str, signs: str) -> Callable[[Column], Column]:
    """signs: characters of which each match has one; a text without them is left as it is."""

    def blanks(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.when(t.rlike(f"[{signs}]"), _joined(t, pattern, F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m))))).otherwise(t)

    return lambda c: _let(c, blanks)


#: For Java: possessive, since backing up over a host's labels never helps, and doing so takes stack for each label.
_JAVA_URL = URL.replace("(?:[A-Za-z0-9-]+[.])+", "(?:[A-Za-z0-9-]++[.])++")
_WORD_HASHTAG = r"[#＃][\p{L}\p{N}_]*[\p{L}\p{Nl}\p{No}_][\p{L}\p{N}_]*"
#: Entities overwritten by as many blanks: the length of a text stays. Texts stay with Spark, without a copy in Python.
blank_urls, blank_mentions, blank_entities = _blank(_JAVA_URL, "/"), _blank(MENTION, "@＠"), _blank(f"{_JAVA_URL}|{MENTION}|{_WORD_HASHTAG}", "/@＠#＃")
_CHARREF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape_html(c: Column) -> Column:
    """Only references to characters go through Python, not the texts around them."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield found.map(lambda marks: None if marks is None else [html.unescape(m) for m in marks])

    return _joined(c, _CHARREF, run(F.regexp_extract_all(c, F.lit(_CHARREF), F.lit(0))))


def clean(c: Column) -> Column:
    """Mentions, links and patterns out, HTML unescaped, numbers out."""
    return strip_numbers(unescape_html(strip_patterns(blank_urls(blank_mentions(c)))))


def remove_all(c: Column) -> Column:
    return strip_patterns(blank_entities(c))
