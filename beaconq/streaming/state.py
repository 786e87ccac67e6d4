"""Keyed state over time: provider coordinator, rate limit, 24-hour dedup, frontier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from beaconq.operators import telemetry

COMMANDS = "key string, at_ms long, nth long, command string, failure_kind string, duration_ms long"
SNAPSHOTS = (
    "key string, at_ms long, nth long, lease_until long, cooldown_until long, failures int, last_failure string, acquired boolean"
)
STATE = "lease_until long, cooldown_until long, failures int, last_failure string"
Snapshot = tuple[int | None, int | None, int, str | None]
NEW: Snapshot = (None, None, 0, None)


def step(state: Snapshot, at: int, command: str, kind: str | None, duration: int | None) -> tuple[Snapshot, bool]:
    """One command on a provider's state. What has expired goes first: a lease, or a
    cooldown with its failures. A lease is given if neither is in force."""
    lease, cooldown, failures, last = state
    if lease is not None and lease <= at:
        lease = None
    if cooldown is not None and cooldown <= at:
        cooldown, failures, last = None, 0, None
    acquired = command == "acquire" and lease is None and cooldown is None
    if acquired:
        lease = at + (duration or 0)
    elif command == "success":
        lease, cooldown, failures, last = None, None, 0, None
    elif command == "failure":
        lease, cooldown, failures, last = None, at + (duration or 0), failures + 1, kind
    return (lease, cooldown, failures, last), acquired


def _none(x):
    return None if pd.isna(x) else x


def run(state: Snapshot, rows: pd.DataFrame) -> tuple[Snapshot, pd.DataFrame]:
    out = []
    for r in rows.sort_values(["at_ms", "nth"]).itertuples():
        state, acquired = step(state, r.at_ms, r.command, _none(r.failure_kind), _none(r.duration_ms))
        out.append((r.key, r.at_ms, r.nth, *state, acquired))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in SNAPSHOTS.split(", ")])
    return state, frame.astype({"lease_until": "Int64", "cooldown_until": "Int64"})


def coordinate(commands: DataFrame) -> DataFrame:
    """Snapshot after every command, over a stored table. A key's commands are folded in
    order of time and number, batch after batch, with its state alone in memory."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, NEW
        for batch in batches:
            for key, rows in batch.groupby("key", sort=False, dropna=False):
                if key != last:
                    last, state = key, NEW
                state, out = run(state, rows)
                yield out

    ordered = commands.repartition("key").sortWithinPartitions("key", "at_ms", "nth")
    return ordered.mapInPandas(fold, SNAPSHOTS)


def coordinate_stream(commands: DataFrame) -> DataFrame:
    """The same over a stream: commands of a micro-batch are put in order by key."""

    def update(key, batches, state) -> Iterator[pd.DataFrame]:
        snapshot = tuple(map(_none, state.get)) if state.exists else NEW
        snapshot, out = run(snapshot, pd.concat(list(batches)))
        state.update(snapshot)
        yield out

    return commands.groupBy("key").applyInPandasWithState(update, SNAPSHOTS, STATE, "append", "NoTimeout")


#: Engines that pause after failures: milliseconds, and the failures that make them.
PAUSES = {
    "duckduckgo-html": (60_000, ["ENGINE_RATE_LIMITED", "ENGINE_CHALLENGED"]),
    "brave-news": (60_000, ["ENGINE_RATE_LIMITED", "ENGINE_CHALLENGED"]),
    "startpage-web": (60_000, ["ENGINE_RATE_LIMITED", "ENGINE_CHALLENGED"]),
    "google-web": (300_000, ["ENGINE_RATE_LIMITED", "ENGINE_CHALLENGED", "ENGINE_ACCESS_DENIED"]),
}


def commands_of(reports: DataFrame) -> DataFrame:
    """Coordinator commands from reports (engine_id, at_ms, nth, failure_kind): a pause
    after those failures that call for one, a success after an answer."""
    pause = F.lit(None).cast("long")
    for engine, (ms, kinds) in PAUSES.items():
        pause = F.when((F.col("engine_id") == engine) & F.col("failure_kind").isin(*kinds), F.lit(ms)).otherwise(pause)
    command = F.when(pause.isNotNull(), "failure").when(F.col("failure_kind").isNull(), "success")
    rows = reports.filter(F.col("engine_id").isin(*PAUSES))
    return rows.select(F.col("engine_id").alias("key"), "at_ms", "nth", command.alias("command"), "failure_kind", pause.alias("duration_ms")).filter("command IS NOT NULL")


def gate(selected: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Engines of requests (request_id, engine_id, at_ms) with ``failure_kind`` set for
    those whose cooldown, by the last snapshot before, is still in force.

    A snapshot holds until the next of its engine or until its cooldown ends, a few
    minutes at most, so requests meet cooldowns by engine and minute."""
    following = F.lead("at_ms").over(W.partitionBy("key").orderBy("at_ms", "nth"))
    held = snapshots.withColumn("until", F.least("cooldown_until", F.coalesce(following, "cooldown_until"))).filter("cooldown_until IS NOT NULL AND until > at_ms")
    minutes = F.sequence(F.floor(F.col("at_ms") / 60_000), F.floor((F.col("until") - 1) / 60_000))
    held = held.select(F.col("key").alias("engine_id"), F.col("at_ms").alias("_from"), F.col("until").alias("_until"), F.explode(minutes).alias("_minute"))
    asked = selected.withColumn("_minute", F.floor(F.col("at_ms") / 60_000))
    inside = (F.col("at_ms") >= F.col("_from")) & (F.col("at_ms") < F.col("_until"))
    stopped = asked.join(held, ["engine_id", "_minute"]).filter(inside).select("request_id", "engine_id", "at_ms").distinct()
    rows = selected.join(stopped.withColumn("failure_kind", F.lit("ENGINE_RATE_LIMITED")), ["request_id", "engine_id", "at_ms"], "left")
    return rows


def over_limit_stream(calls: DataFrame, most: int = 60, late: str = "1 minute") -> DataFrame:
    return telemetry.over_limit(calls.withWatermark("ts", late), most)


def new_pages(pages: DataFrame, hours: int = 24) -> DataFrame:
    """Pages (url, ts) of a stream, each once in so many hours."""
    return pages.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["url"])


def drain(frontier: DataFrame, crawl: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "30 minutes", batch: int = 4):
    """Hand the frontier stream (digest, url) to ``crawl`` in batches by digest. Of a batch
    of the stream no row is left out: ``crawl`` gets them ``batch`` at a time. ``every``
    None: all that is there now."""

    def each(rows: DataFrame, epoch: int) -> None:
        known = rows.dropDuplicates(["digest"]).persist()
        try:
            last = None
            while True:
                rest = known if last is None else known.filter(F.col("digest") > last)
                part = rest.orderBy("digest").limit(batch)
                digests = [r["digest"] for r in part.select("digest").collect()]
                if not digests:
                    return
                crawl(known.filter(F.col("digest").isin(digests)), epoch)
                last = max(digests)
        finally:
            known.unpersist()

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return frontier.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
