"""Login limits and refresh tokens as they happen: a row out for each event in, by state that outlives batches and restarts.

The same rules as operators.sessions folds over a whole log. State is keyed: a login key's count and its window's start;
a token family's live token, whether it is revoked, and its spent tokens one by one, so that an event reads no
more than the token it presents. Within a batch a key's events are taken in order of (ts, seq); batches must follow in time.

What has run out leaves by event-time timers, when the watermark has passed it: a login window after
its end, a token family `idle` after its last event. (The time to live that state stores offer counts processing time, so
a stream that lags behind would lose windows that are still open; and a stream in that mode never ends under availableNow.)
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sessions import ATTEMPTS, WINDOW_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB: on the executors' disks, with what changes in the checkpoint. A stream takes the setting as it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Limiter(StatefulProcessor):
    """A fixed window from the first failure: `limit` failures block until it ends, a success clears them."""

    def __init__(self, limit: int, window: int):
        self.limit, self.span = limit, window * 1_000_000

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("window", "failures bigint, opened bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        n, opened = (held[0], held[1]) if held else (0, None)
        begun = opened
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            if opened is not None and r.at >= opened + self.span:
                n, opened = 0, None
            stop = n >= self.limit
            if not stop:
                n, opened = (n + 1, r.at if opened is None else opened) if r.failed else (0, None)
            yield Row(key=key[0], seq=r.seq, failures=n, blocked=stop, retry_after=(opened + self.span - r.at + 500_000) // 1_000_000 if stop else None)
        if opened is None:
            self.state.clear()
            return
        self.state.update((n, opened))
        if opened != begun:
            self.handle.registerTimer((opened + self.span) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # a later window may have opened since
        held = self.state.get() if self.state.exists() else None
        if held and (held[1] + self.span) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class Rotation(StatefulProcessor):
    """Refresh tokens by family: the live one rotates, a spent one revokes the family."""

    def __init__(self, idle: int):
        self.idle = idle * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("family", "live string, revoked boolean, last bigint")
        self.spent = handle.getMapState("spent", "token string", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        live, dead, last = (held[0], held[1], held[2]) if held else (None, False, 0)
        begun = held is not None
        now: dict[str, int] = {}
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            if not begun:
                live, begun = r.token, True
            replaced = None
            was_spent = r.token != live and (r.token in now or self.spent.containsKey((r.token,)))
            if was_spent or dead and r.token == live:
                outcome, dead = "reuse", True
            elif r.token != live:
                outcome = "unknown"
            elif r.expired or r.inactive:
                outcome = "expired" if r.expired else "inactive"
            else:
                now[live] = r.seq
                outcome, live, replaced = "rotated", r.new_token, r.new_token
            last = max(last, r.at // 1000)
            yield Row(family=key[0], seq=r.seq, token=r.token, outcome=outcome, family_revoked=dead, replaced_by=replaced)
        for token, seq in now.items():
            self.spent.updateValue((token,), (seq,))
        self.state.update((live, dead, last))
        self.handle.registerTimer(last + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        if held and held[2] + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            self.spent.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited(attempts: DataFrame, limit: int = ATTEMPTS, window: int = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """A stream of attempts(key, ts, seq, failed) as key, seq, failures, blocked, retry_after. Start it within rocksdb()."""
    rows = attempts.select("key", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("bigint").alias("seq"), "failed").withWatermark("ts", late)
    out = f"key {attempts.schema['key'].dataType.simpleString()}, seq bigint, failures bigint, blocked boolean, retry_after bigint"
    return rows.groupBy("key").transformWithState(Limiter(limit, window), out, "Append", "EventTime")


def rotated(events: DataFrame, idle: int = 30 * 86_400, late: str = "10 minutes") -> DataFrame:
    """A stream of events(family, ts, seq, token, new_token and, if they can be, expired and inactive) as family, seq, token, outcome, family_revoked, replaced_by. idle: the seconds after which a family without events is forgotten, at least a token's life. Start it within rocksdb()."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in events.columns else F.lit(False).alias(c) for c in ("expired", "inactive")]
    ts = F.col("ts").cast("timestamp")
    rows = events.select("family", ts.alias("ts"), F.unix_micros(ts).alias("at"), F.col("seq").cast("bigint").alias("seq"), "token", "new_token", *flags).withWatermark("ts", late)
    out = f"family {events.schema['family'].dataType.simpleString()}, seq bigint, token string, outcome string, family_revoked boolean, replaced_by string"
    return rows.groupBy("family").transformWithState(Rotation(idle), out, "Append", "EventTime")
