"""Dead letters: records of failed raw events, their replay and their retry plan."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.functions.event_id import event_id

DEFAULT_MAX_ATTEMPTS = 3
DEFAULT_BASE_MS = 100
DEFAULT_MAX_MS = 10_000
# Cap used when only the retry policy is configured, not the delays.
RETRY_MAX_MS = 5_000
PROVIDER_MAX_MS = 2_000


def dead_letters(
    failed: DataFrame,
    reason: Column | None = None,
    attempts: Column | int | None = None,
    failed_at: Column | None = None,
) -> DataFrame:
    """Raw event columns plus reason and attempts to dead-letter records.

    Unless given, ``attempts`` is one more than the ``attempt_count`` of a replayed row, else 1.
    """
    if attempts is None and "attempt_count" in failed.columns:
        attempts = F.coalesce("attempt_count", F.lit(0)) + 1
    attempts = attempts if isinstance(attempts, Column) else F.lit(attempts or 1)
    values = {
        "event_id": event_id(F.col("stream_id"), F.col("seq_no")),
        "stream_id": F.col("stream_id"),
        "seq_no": F.col("seq_no"),
        "source": F.col("source"),
        "raw_payload": F.col("payload"),
        "reason": F.col("reason") if reason is None else reason,
        "failed_at": F.current_timestamp() if failed_at is None else failed_at,
        "attempt_count": attempts,
    }
    return failed.select(
        *[values[field.name].cast(field.dataType).alias(field.name) for field in S.DEAD_LETTER]
    )


def replay(letters: DataFrame) -> DataFrame:
    """Dead letters back to raw events, received when they failed; ``attempt_count`` goes along."""
    return letters.select(
        "source",
        F.col("raw_payload").alias("payload"),
        "stream_id",
        F.col("failed_at").alias("received_at"),
        "seq_no",
        "attempt_count",
    )


def delay_cap_ms(
    attempt: Column, base_ms: int = DEFAULT_BASE_MS, max_ms: int = DEFAULT_MAX_MS
) -> Column:
    """Upper end of the delay after ``attempt`` retries: doubles with each up to the maximum."""
    base = base_ms if base_ms > 0 else DEFAULT_BASE_MS
    cap = max_ms if max_ms > 0 else DEFAULT_MAX_MS
    doubled = F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(0)))
    return F.least(doubled, F.lit(float(cap)))


def retry_plan(
    letters: DataFrame,
    max_attempts: int = DEFAULT_MAX_ATTEMPTS,
    retryable: Column | None = None,
    base_ms: int = DEFAULT_BASE_MS,
    max_ms: int = RETRY_MAX_MS,
    seed: int = 0,
    delay=delay_cap_ms,
) -> DataFrame:
    """Add ``eligible``, ``delay_cap_ms`` and ``next_attempt_at`` to dead letters.

    A letter is tried again while attempts are left and its failure is retryable; the wait is
    uniform between zero and the cap, drawn from the event id, the attempt and ``seed``, so that a
    plan made again is the same. The first retry waits up to the base delay. ``delay`` may be
    replaced by another cap expression of the number of retries so far.
    """
    limit = max_attempts if max_attempts > 0 else DEFAULT_MAX_ATTEMPTS
    left = F.col("attempt_count") < limit
    eligible = left if retryable is None else left & retryable
    planned = letters.withColumn("eligible", F.coalesce(eligible, F.lit(False))).withColumn(
        "delay_cap_ms", delay(F.col("attempt_count") - 1, base_ms, max_ms)
    )
    draw = F.pmod(F.xxhash64("event_id", "attempt_count", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    wait_us = (draw * F.col("delay_cap_ms") * 1000).cast("bigint")
    due = F.timestamp_micros(F.unix_micros("failed_at") + wait_us)
    return planned.withColumn("next_attempt_at", F.when(F.col("eligible"), due))
