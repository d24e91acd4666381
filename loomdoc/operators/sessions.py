"""Login limits, refresh tokens and job states, replayed from event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPTS, WINDOW_SECONDS = 5, 900


def login_limits(attempts: DataFrame, limit: int = ATTEMPTS, window: int = WINDOW_SECONDS) -> DataFrame:
    """attempts(key, ts, seq, failed) with failures, blocked and retry_after: a fixed window that opens with the first failure.

    An attempt while `limit` failures stand is blocked and changes nothing; a success
    clears them. retry_after: the seconds that are left of the window, rounded, where
    blocked. A key's attempts stream by in order of time; only its count and its window's
    start are held.
    """
    span = window * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, opened = None, 0, None
        for batch in batches:
            counts, stops, rests = [], [], []
            for key, ts, failed in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if key != now:
                    now, n, opened = key, 0, None
                if opened is not None and ts >= opened + span:
                    n, opened = 0, None
                stop = n >= limit
                if not stop:
                    n, opened = (n + 1, ts if opened is None else opened) if failed else (0, None)
                counts.append(n)
                stops.append(stop)
                rests.append((opened + span - ts + 500_000) // 1_000_000 if stop else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(stops), pa.array(rests, pa.int64())], names=["key", "seq", "failures", "blocked", "retry_after"])

    rows = attempts.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("seq").cast("bigint"), "failed")
    ordered = rows.repartition("key").sortWithinPartitions("key", "ts", "seq")
    return ordered.mapInArrow(run, f"key {attempts.schema['key'].dataType.simpleString()}, seq bigint, failures bigint, blocked boolean, retry_after bigint")


def rotate_tokens(events: DataFrame) -> DataFrame:
    """Outcome of each refresh: events(family, seq, token, new_token and, if they can be, expired and inactive) -> outcome, family_revoked, replaced_by.

    A family begins with its first event's token. A token that is not of the family is
    unknown; presenting a spent one is reuse and revokes the whole family; then an expired
    one and an inactive user are refused; the live token rotates to new_token, which
    replaces it. A family's events stream by in order; its spent tokens are held.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in events.columns else F.lit(False).alias(c) for c in ("expired", "inactive")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, live, spent, dead = None, None, set(), False
        for batch in batches:
            out = []
            for family, token, new, expired, inactive in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True):
                if family != now:
                    now, live, spent, dead = family, token, set(), False
                replaced = None
                if token in spent or dead and token == live:
                    outcome, dead = "reuse", True
                elif token != live:
                    outcome = "unknown"
                elif expired or inactive:
                    outcome = "expired" if expired else "inactive"
                else:
                    outcome, live, replaced = "rotated", new, new
                    spent.add(token)
                out.append((outcome, dead, replaced))
            outcome, dead_, replaced_ = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(outcome, pa.string()), pa.array(dead_, pa.bool_()), pa.array(replaced_, pa.string())], names=["family", "seq", "token", "outcome", "family_revoked", "replaced_by"])

    rows = events.select("family", F.col("seq").cast("bigint"), "token", "new_token", *flags)
    return rows.repartition("family").sortWithinPartitions("family", "seq").mapInArrow(run, f"family {events.schema['family'].dataType.simpleString()}, seq bigint, token string, outcome string, family_revoked boolean, replaced_by string")


def revoke(tokens: DataFrame, match: Column, now: Column) -> DataFrame:
    """tokens with revoked_at set on matching rows that are not yet revoked."""
    return tokens.withColumn("revoked_at", F.coalesce("revoked_at", F.when(match, now)))


def refresh_status(presented: DataFrame, tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """presented(raw) with status: unknown, revoked, expired, inactive or valid, the first that holds."""
    t = presented.withColumn("token_hash", F.sha2("raw", 256)).join(tokens, "token_hash", "left").join(users.select(F.col("id").alias("user_id"), "is_active"), "user_id", "left")
    status = F.when(F.col("expires_at").isNull(), "unknown").when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= now, "expired").when(~F.coalesce("is_active", F.lit(False)), "inactive").otherwise("valid")
    return t.select("raw", "user_id", status.alias("status"))


def login_status(presented: DataFrame, users: DataFrame) -> DataFrame:
    """presented with user_id and status: unknown, inactive or allowed to go on to the password. presented: username and more; users: id, username, is_active."""
    t = presented.join(users.select(F.col("id").alias("user_id"), "username", "is_active"), "username", "left")
    status = F.when(F.col("user_id").isNull(), "unknown").when(~F.coalesce("is_active", F.lit(False)), "inactive").otherwise("allowed")
    return t.withColumn("status", status).drop("is_active")


def job_states(log: DataFrame) -> DataFrame:
    """A row for each run of a (document, stage): run, status, started_at, finished_at, error_message, duration_ms. log: document_id, stage, status, ts, seq, error_message.

    A run begins with "running"; what ends before any begins is run 0, without a start.
    """
    order, upto = F.struct("ts", "seq"), Window.partitionBy("document_id", "stage").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("run", F.sum((F.col("status") == "running").cast("bigint")).over(upto))
    ended = F.col("status").isin("done", "failed")
    g = rows.groupBy("document_id", "stage", "run").agg(
        F.max_by("status", order).alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.max(F.when(ended, F.col("ts"))).alias("finished_at"), F.max_by("error_message", order).alias("error_message")
    )
    return g.select("document_id", "stage", "run", "status", "started_at", "finished_at", F.when(F.col("status") == "failed", F.col("error_message")).alias("error_message"), F.timestamp_diff("MILLISECOND", "started_at", "finished_at").alias("duration_ms"))


def document_states(jobs: DataFrame) -> DataFrame:
    """Status of each document by the last run of each stage: failed if one failed, processing while one runs, else ready."""
    last = jobs.groupBy("document_id", "stage").agg(F.max_by("status", "run").alias("status"))
    return last.groupBy("document_id").agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status") == "running"), "processing").otherwise("ready").alias("status"))


def list_jobs(jobs: DataFrame, document_id: int) -> DataFrame:
    """A document's jobs by id, with times as ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return jobs.where(F.col("document_id") == document_id).withColumn("started_at", iso("started_at")).withColumn("finished_at", iso("finished_at")).orderBy("id")
