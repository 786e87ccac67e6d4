"""Values with a time to live, asked for while they come: caches and continuations.

A stream of (key, at, put, order_by, tie, value, expires_at, request_id): rows that put a
value, and rows that ask for it at their time. Of a key's values the last by (order_by, tie)
is kept until it expires by event time, when a timer drops it from the state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

ROWS = "key string, at timestamp, put boolean, order_by long, tie string, value string, expires_at timestamp, request_id string"
ANSWERS = "request_id string, key string, value string"
#: Keys are dealt to so many shares by hash. The values of a share are kept and timed together,
#: as every call for state is a trip from Python to its store and back.
SHARES = 4096
STATE = "held array<struct<key: string, order_by: long, tie: string, value: string, expires_ms: long>>, due_ms long"


def millis(moment) -> int:
    return round(moment.timestamp() * 1000)


class Expiring(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("share", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.state.get()
        held = {h[0]: tuple(h) for h in kept[0]} if kept else {}
        changed = False
        for r in sorted(rows, key=lambda r: (r.at, not r.put)):
            now = held.get(r.key)
            if r.put:
                if now is None or (r.order_by, r.tie or "") > (now[1], now[2] or ""):
                    held[r.key], changed = (r.key, r.order_by, r.tie, r.value, millis(r.expires_at)), True
            else:
                alive = now is not None and now[4] > millis(r.at)
                yield Row(request_id=r.request_id, key=r.key, value=now[3] if alive else None)
        if changed:
            self._keep(held, kept[1] if kept else None)

    def _keep(self, held: dict, due: int | None) -> None:
        """Store a share's values, with a timer for the first of them that expires."""
        first = min(h[4] for h in held.values())
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
        self.state.update((list(held.values()), first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept, now = self.state.get(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if kept:
            held = {h[0]: tuple(h) for h in kept[0] if h[4] > now}
            if held:
                self._keep(held, None)
            else:
                self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_of_moment(puts: DataFrame, part: str) -> DataFrame:
    """Rows that put a value, without those that another of the same key, moment and step
    outdoes: who asks in that moment is answered after all of them."""
    by = F.struct("order_by", F.coalesce("tie", F.lit("")))
    last = puts.groupBy(part, "key", "at").agg(F.max_by(F.struct(*[c for c in puts.columns if c not in (part, "key", "at")]), by).alias("last"))
    return last.select(*[c if c in (part, "key", "at") else F.col("last")[c].alias(c) for c in puts.columns])


def answered(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(request_id, key, value) of the rows that ask; null where no value is alive. Rows
    that are later than the watermark allows are dropped, as Spark does before it hands
    rows over; values are kept until the watermark passes their expiry."""
    keyed = rows.withWatermark("at", late).withColumn("share", F.pmod(F.xxhash64("key"), F.lit(SHARES))).groupBy("share")
    return keyed.transformWithState(Expiring(), ANSWERS, "append", "EventTime")
