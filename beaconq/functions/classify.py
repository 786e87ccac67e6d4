"""What a stored provider response is: failures by status, headers and body."""

from __future__ import annotations

from functools import reduce
from operator import or_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, functions as F

from beaconq.functions.text import bound

SCAN_BYTES = 65_536
MOST_BYTES = 2 * 1024 * 1024
#: Markers in the lower-case head of a body, in the order of testing.
RATE_MARKERS = ["rate limit exceeded", "secondary rate limit", "too many requests", "request quota exceeded"]
CHALLENGE_MARKERS = [
    "cf-chl-", "cloudflare ray id", "attention required", "captcha", "challenge-form", "verify you are human", "/sorry/",
    "unusual traffic",
]
DENIED_MARKERS = ["access denied", "request blocked", "permission denied", "forbidden"]
CHALLENGE_HEADERS = ["x-amzn-waf-action", "cf-mitigated"]
REDIRECT_MARKERS = ["captcha", "/sorry/", "challenge"]
#: Failure kinds that may be tried again, and the API's status for each code.
RETRYABLE = ["ENGINE_TIMEOUT", "ENGINE_RATE_LIMITED"]


def _any(text: Column, markers: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(m)) for m in markers])


def lowered(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def body_failure(status: Column, body: Column) -> Column:
    """Failure kind from status and body text, null if it looks like an answer. The head is
    put in lower case once for all markers."""
    head = lowered(F.substring(F.coalesce(body, F.lit("")).cast("binary"), 1, SCAN_BYTES).cast("string"))
    return bound(
        F.when(status == 429, RATE_MARKERS[0]).otherwise(head),
        lambda h: F.when(_any(h, RATE_MARKERS), "ENGINE_RATE_LIMITED")
        .when(_any(h, CHALLENGE_MARKERS), "ENGINE_CHALLENGED")
        .when((status == 403) | _any(h, DENIED_MARKERS), "ENGINE_ACCESS_DENIED"),
    )


def header_failure(headers: Column) -> Column:
    found = F.exists(
        F.map_entries(headers), lambda e: F.lower(e["key"]).isin(CHALLENGE_HEADERS) & (F.lower(e["value"]) == "challenge")
    )
    return F.when(found, "ENGINE_CHALLENGED")


def redirect_failure(location: Column) -> Column:
    return F.when(_any(F.lower(location), REDIRECT_MARKERS), "ENGINE_CHALLENGED")


def content_failure(status: Column, content_type: Column, size: Column, expected: Column) -> Column:
    """Size, then status, then media type; an empty 202 or 204 needs no type."""
    media = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    empty = status.isin(202, 204) & (size == 0)
    return (
        F.when(size > MOST_BYTES, "ENGINE_RESPONSE_TOO_LARGE")
        .when(~status.between(200, 299), "ENGINE_ACCESS_DENIED")
        .when(~empty & ~F.array_contains(expected, media), "ENGINE_INVALID_CONTENT_TYPE")
    )


def response_failure(status, headers, location, body, content_type, size, expected) -> Column:
    """All classifiers in their order; null for a response to be parsed."""
    return F.coalesce(
        redirect_failure(location), header_failure(headers), body_failure(status, body), content_failure(status, content_type, size, expected)
    )


def retryable(kind: Column) -> Column:
    return F.coalesce(kind.isin(RETRYABLE), F.lit(False))


def outcome(kind: Column) -> Column:
    return F.when(kind.isNull(), "success").otherwise("failure")
