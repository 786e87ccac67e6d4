"""Signed cursors as columns: made, verified and used for the next page, without Python.

A cursor is the JSON text of its payload and the HMAC-SHA256 of that, each as base64url
without padding, joined by a dot. The HMAC is composed of two SHA-256 over the key's pads.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from beaconq.functions.text import bound

CURSOR_MS = 900_000
BLOCK = 64
PAYLOAD = "query_hash string, page long, engine_cursors map<string,string>, expires_at_ms long"


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The key XOR the inner and the outer pad; a key longer than a block is hashed first."""
    block = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(message: Column, key: bytes) -> Column:
    inner, outer = map(F.lit, pads(key))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256))


def base64url(value: Column) -> Column:
    """Base64url without padding and without the line ends that Spark's base64 has."""
    return F.rtrim(F.translate(F.base64(value), "+/\r\n", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """Bytes of base64url without padding; null for any other text."""
    good = text.rlike(r"^[A-Za-z0-9_-]+$") & (F.length(text) % 4 != 1)
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    raw = F.try_to_binary(F.translate(F.when(good, padded), "-_", "+/"), F.lit("base64"))
    # The last character may carry bits of no byte, which a strict reader refuses.
    return bound(raw, lambda r: F.when(base64url(r) == text, r))


def sign(query_hash: Column, page: Column, engine_cursors: Column, now_ms: Column, key: bytes) -> Column:
    """The cursor's text; engine cursors are written in order of their engines."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(engine_cursors)))
    payload = F.struct(query_hash.alias("query_hash"), page.alias("page"), ordered.alias("engine_cursors"), (now_ms + CURSOR_MS).alias("expires_at_ms"))
    body = F.to_json(payload).cast("binary")
    return F.concat(base64url(body), F.lit("."), base64url(hmac_sha256(body, key)))


def opened(cursor: Column, query_hash: Column, now_ms: Column, key: bytes) -> Column:
    """(failure, payload): the payload if the cursor is genuine, not expired and of this
    query, else why not. Signatures are compared by their keyed digests, so that how long
    it takes says nothing of how far they agree."""
    half = lambda halves, k: bound(F.get(halves, F.lit(k)), from_base64url)
    halves = bound(F.split(cursor, r"\.", 2), lambda h: F.struct(half(h, 0).alias("body"), half(h, 1).alias("mac")))

    def verified(h: Column) -> Column:
        body, mac = h["body"], h["mac"]
        same = hmac_sha256(mac, key) == hmac_sha256(hmac_sha256(body, key), key)
        why = F.when(body.isNull() | mac.isNull(), "invalid encoding").when(~same, "invalid signature")
        return bound(why, lambda w: F.struct(w.alias("why"), F.from_json(F.when(w.isNull(), F.decode(body, "utf-8")), PAYLOAD).alias("payload")))

    def judged(v: Column) -> Column:
        payload = v["payload"]
        failure = (
            F.when(v["why"].isNotNull(), v["why"])
            .when(payload["expires_at_ms"].isNull() | payload["query_hash"].isNull() | payload["page"].isNull(), "invalid payload")
            .when(payload["expires_at_ms"] <= now_ms, "expired")
            .when(payload["query_hash"] != query_hash, "cursor does not belong to this query and engine selection")
        )
        return bound(failure, lambda f: F.struct(f.alias("failure"), F.when(f.isNull(), payload).alias("payload")))

    return bound(bound(halves, verified), judged)


def resumed(requests: DataFrame, key: bytes, now_ms: Column) -> DataFrame:
    """Requests (cursor, query_hash, page) with ``page`` and ``engine_cursors`` of their
    cursor and ``failure`` if it cannot be used; requests without one keep their page. The
    cursor is opened once: the optimizer does not merge a projection with an explode."""
    rows = requests.select("*", F.explode(F.array(opened(F.col("cursor"), F.col("query_hash"), now_ms, key))).alias("_c"))
    given = F.col("cursor").isNotNull()
    return rows.withColumns(
        {
            "failure": F.when(given & F.col("_c.failure").isNotNull(), "INVALID_CURSOR"),
            "page": F.when(given, F.col("_c.payload.page")).otherwise(F.col("page").cast("long")),
            "engine_cursors": F.when(given, F.col("_c.payload.engine_cursors")),
        }
    ).drop("_c")


def with_next(answers: DataFrame, key: bytes, now_ms: Column) -> DataFrame:
    """Answers (query_hash, page, may_have_more, engine_cursors) with ``next_cursor`` where more may follow."""
    cursor = sign(F.col("query_hash"), F.col("page").cast("long") + 1, F.col("engine_cursors"), now_ms, key)
    return answers.withColumn("next_cursor", F.when(F.col("may_have_more"), cursor))


def seek(rows: DataFrame, last_score: Column, last_url: Column, limit: int) -> DataFrame:
    """The next ``limit`` rows of each request after a place in the order of score and URL
    (null: from the start), which needs no ranks of what came before."""
    from beaconq.operators.rank import top

    after = last_score.isNull() | (F.col("score") < last_score) | ((F.col("score") == last_score) & (F.col("canonical_url") > last_url))
    return top(rows.filter(after), limit)
