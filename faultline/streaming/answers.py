"""Requests and their answers as two streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schemas as S
from faultline.operators.diagnose import decoded_answers


def match_answers(
    requested: DataFrame,
    answers: DataFrame,
    limit_seconds: float,
    lateness_seconds: float = 0,
) -> DataFrame:
    """One diagnosis per request, also where no answer comes: streaming form of ``diagnose.responses``.

    ``requested`` has ``event_id``, ``signature`` and ``sent_at``, ``answers`` have ``event_id``, ``status``, ``body`` and
    ``answered_at``. Answers count that come from the sending on for ``limit_seconds``; of several a usable one is
    taken, and among equally usable ones the largest by value. A request's row is given when the clocks of both streams (the
    greatest time so far less ``lateness_seconds``) have passed its limit, as a provider failure if there was no answer.
    Requests without event id have no row; requests sent again at another time are requests of their own.

    The plan is an outer join in a time interval, then an aggregate per request: both keep only the state that the clocks
    have not passed.
    """
    late = f"{int(lateness_seconds * 1000)} milliseconds"
    asked = requested.filter(F.col("event_id").isNotNull()).select("event_id", "signature", "sent_at").withWatermark("sent_at", late)
    told = decoded_answers(answers, "answered_at").withColumnRenamed("event_id", "_answered").withWatermark("answered_at", late)
    in_time = (
        (F.col("event_id") == F.col("_answered"))
        & (F.col("answered_at") >= F.col("sent_at"))
        & (F.col("answered_at") <= F.col("sent_at") + F.expr(f"interval {int(limit_seconds * 1000)} milliseconds"))
    )
    rest = [name for name in S.DIAGNOSIS.names if name not in ("event_id", "signature")]
    best = F.max(
        F.struct(
            F.col("_answered").isNotNull().alias("_there"), (F.col("failure") == "").alias("_usable"), "failure", *rest
        )
    ).alias("_best")
    joined = asked.join(told, in_time, "leftOuter")
    # A group ends when the clock has passed its time of sending.
    grouped = joined.groupBy("event_id", "signature", "sent_at").agg(best)
    return grouped.select(
        "event_id",
        "signature",
        *[F.col("_best")[name].alias(name) for name in rest],
        F.coalesce(F.col("_best")["failure"], F.lit(S.PROVIDER_FAILED)).alias("failure"),
        "sent_at",
    )
