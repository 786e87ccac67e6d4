"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


#: Characters that NFKC leaves as they are, whatever stands beside them: texts of these alone need no ``nfkc``.
STABLE = r"\u0000-\u007F\u00A1\u00AB\u00BB\u00BF\u00C0-ı\u2013\u2014\u2018-\u201E"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:  # pragma: no cover - runs in workers
    import unicodedata

    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def composed(text: Column) -> Column:
    """NFKC; a null text is empty. Only texts that it may change are sent to Python."""
    text = F.coalesce(text, F.lit(""))
    may_change = (F.octet_length(text) != F.char_length(text)) & text.rlike(f"[^{STABLE}]")
    return F.coalesce(nfkc(F.when(may_change, text)), text)


def normalize(text: Column) -> Column:
    """NFKC, lower case, runs of anything but letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(composed(text)), SEPARATORS, " "))


def words(text: Column) -> Column:
    """Normalised words in order; none for a text without letters or digits."""
    return F.array_remove(F.split(F.lower(composed(text)), SEPARATORS), "")


def tokens(text: Column) -> Column:
    """Distinct normalised words, sorted."""
    return F.sort_array(F.array_distinct(words(text)))


def coverage(query_tokens: Column, normalized: Column) -> Column:
    """Share of the query's tokens that a normalised text has as words, or of which, from
    four characters on, some word of the text is a continuation; 0 for no tokens.

    Words of a normalised text stand between single spaces, so a token is looked for in
    the text itself, which is not cut into words for it.
    """
    # An array of one binds both, as a lambda must not hold the Python of ``nfkc``.
    both = F.array(F.struct(query_tokens.alias("q"), F.concat(F.lit(" "), normalized, F.lit(" ")).alias("t")))

    def share(b: Column) -> Column:
        word = lambda q: F.concat(F.lit(" "), q, F.when(F.char_length(q) >= 4, "").otherwise(" "))
        found = F.filter(b["q"], lambda q: F.contains(b["t"], word(q)))
        return F.when(F.size(b["q"]) > 0, F.size(found) / F.size(b["q"])).otherwise(F.lit(0.0))

    return F.element_at(F.transform(both, share), 1)


def trimmed(text: Column) -> Column:
    """Without white space, of Unicode's kind, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_markup(text: Column) -> Column:
    """Tags to spaces (one left open runs to the end), six entities decoded in a set
    order, white space collapsed."""
    plain = F.regexp_replace(text, r"<[^>]*(>|$)", " ")
    #: Entities in the order of decoding.
    for entity, sign in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return collapse(plain)


def publication_year(date: Column) -> Column:
    """First four characters as a year from 1000 to 9999, else null."""
    head = F.substring(date, 1, 4)
    year = F.when(head.rlike("^[0-9]{4}$"), head.cast("int"))
    return F.when(year.between(1000, 9999), year)


def freshness_bonus(year: Column, newest: Column) -> Column:
    age = newest - year
    return (
        F.when(age == 0, 0.05).when(age == 1, 0.04).when(age.between(2, 5), 0.02).otherwise(0.0)
    )


def language_of(locale: Column) -> Column:
    return F.lower(F.element_at(F.split(locale, "[-_]"), 1))


def country_of(locale: Column, country: Column) -> Column:
    """Given country, else the second part of ``ll-CC`` or ``ll_CC``, upper case."""
    return F.upper(F.coalesce(country, F.try_element_at(F.split(locale, "[-_]"), F.lit(2))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rounded_millis(moment: Column) -> Column:
    """Milliseconds since 1970, halves away from zero, as SQL's ``epoch_ms`` gives them."""
    micros = F.unix_micros(moment)
    up = F.abs(micros) + 500
    return (F.signum(micros.cast("double")) * ((up - up % 1000) / 1000)).cast("long")


def days_back(date: Column, time_range: Column) -> Column:
    """A day, week, month or year earlier; days beyond a month's end are clamped."""
    return (
        F.when(time_range == "day", F.date_sub(date, 1))
        .when(time_range == "week", F.date_sub(date, 7))
        .when(time_range == "month", F.add_months(date, -1))
        .when(time_range == "year", F.add_months(date, -12))
    )
