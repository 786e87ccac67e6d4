"""Error codes of the interface: status, title and problem documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Code, status, title.
CODES = [
    ("INVALID_REQUEST", 400, "Invalid request"), ("AUTHENTICATION_REQUIRED", 401, "Authentication required"), ("RATE_LIMITED", 429, "Rate limited"),
    ("UNKNOWN_ENGINE", 404, "Unknown engine"), ("ENGINE_DISABLED", 422, "Engine disabled"), ("UNSUPPORTED_CAPABILITY", 422, "Unsupported capability"),
    ("ENGINE_TIMEOUT", 504, "Engine timed out"), ("ENGINE_RATE_LIMITED", 429, "Engine rate limited"), ("ENGINE_CHALLENGED", 502, "Engine challenged"),
    ("ENGINE_ACCESS_DENIED", 403, "Engine access denied"), ("ENGINE_RESPONSE_TOO_LARGE", 502, "Engine response too large"),
    ("ENGINE_INVALID_CONTENT_TYPE", 502, "Engine returned invalid content"), ("ENGINE_PARSE_FAILED", 502, "Engine response parsing failed"),
    ("NO_ENGINE_SUCCEEDED", 502, "No engine succeeded"), ("INVALID_CURSOR", 400, "Invalid cursor"), ("INTERNAL_ERROR", 500, "Internal error"),
]
#: Kinds of engine failure; each is a code of the same name.
FAILURE_KINDS = [
    "ENGINE_DISABLED", "UNSUPPORTED_CAPABILITY", "ENGINE_TIMEOUT", "ENGINE_RATE_LIMITED", "ENGINE_CHALLENGED", "ENGINE_ACCESS_DENIED",
    "ENGINE_RESPONSE_TOO_LARGE", "ENGINE_INVALID_CONTENT_TYPE", "ENGINE_PARSE_FAILED", "INVALID_REQUEST", "INTERNAL_ERROR",
]
PROBLEMS = "https://problems.invalid/"


def _of(code: Column, at: int) -> Column:
    return F.create_map(*[F.lit(x) for c in CODES for x in (c[0], c[at])])[code]


def status(code: Column) -> Column:
    return _of(code, 1)


def title(code: Column) -> Column:
    return _of(code, 2)


def code_of(kind: Column) -> Column:
    """The code for a kind of engine failure; null for no failure, an internal error for an unknown kind."""
    return F.when(kind.isNotNull(), F.when(kind.isin(*FAILURE_KINDS), kind).otherwise("INTERNAL_ERROR"))


def problem(code: Column, detail: Column, instance: Column, request_id: Column, violations: Column | None = None, base: str = PROBLEMS) -> Column:
    """A problem document as JSON text, with the fields that a request violates."""
    kind = F.concat(F.lit(base), F.replace(F.lower(code), F.lit("_"), F.lit("-")))
    errors = [] if violations is None else [F.transform(violations, lambda v: F.struct(v.alias("field"))).alias("errors")]
    fields = {"type": kind, "title": title(code), "status": status(code), "detail": detail, "instance": instance, "code": code, "request_id": request_id}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()], *errors))
