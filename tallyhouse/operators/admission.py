"""Which vote requests count, and which polls may be made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.messages import MOST_BODY, STRICT, folded, whole_json

#: Rows of polls up to which the table is sent to all executors.
BROADCAST_POLLS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_POLLS) -> DataFrame:
    """Marked for broadcast if a count shows that it is small; else Spark picks a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def request_option(body: Column) -> Column:
    """Option of a request body; 0 if it has none, null if the body is bad or too long.

    What is too long is not looked into.  ``body`` should be a column and no expression that is costly, as it is read several times.
    """
    text = F.when(F.octet_length(body) <= MOST_BODY, body)
    parsed = F.from_json(folded(text, "option_id"), "option_id bigint, _bad string", STRICT)
    good = text.isNotNull() & whole_json(text) & parsed["_bad"].isNull() & parsed.isNotNull()
    return F.when(good, F.coalesce(parsed["option_id"], F.lit(0)))


def admit(requests: DataFrame, polls: DataFrame, failed: DataFrame | None = None, closed: DataFrame | None = None) -> DataFrame:
    """``requests`` (poll_id, option_id, ts, ...) with status, tested in a fixed order.

    400 bad body (null option), 503 poll whose look-up failed (ids in ``failed``), 404 unknown poll, 400 unknown option,
    403 at or after the end or for a poll whose batches were closed before (ids in ``closed``), else 202.  An unknown option of
    a closed poll is thus 400.  ``polls`` has id, options, ends_at.
    """
    known = small(polls.select(F.col("id").alias("poll_id"), F.transform("options", lambda o: o["id"].cast("bigint")).alias("_options"), F.col("ends_at").alias("_ends")))
    rows = requests.join(known, "poll_id", "left")
    for name, ids in (("_failed", failed), ("_closed", closed)):
        if ids is None:
            rows = rows.withColumn(name, F.lit(False))
        else:
            marked = small(ids.select("poll_id").distinct().withColumn(name, F.lit(True)))
            rows = rows.join(marked, "poll_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    status = (
        F.when(F.col("option_id").isNull(), 400)
        .when(F.col("_failed"), 503)
        .when(F.col("_ends").isNull(), 404)
        .when(~F.array_contains("_options", F.col("option_id").cast("bigint")), 400)
        .when((F.col("ts") >= F.col("_ends")) | F.col("_closed"), 403)
        .otherwise(202)
    )
    return rows.withColumn("status", status).drop("_options", "_ends", "_failed", "_closed")


def status_counts(admitted: DataFrame, *keys: str) -> DataFrame:
    of = lambda code: F.count_if(F.col("status") == code)
    return admitted.groupBy(*keys).agg(of(202).alias("accepted"), of(403).alias("forbidden"), of(400).alias("bad"), of(404).alias("unknown"))


def validate_polls(requests: DataFrame, now: Column) -> DataFrame:
    """``requests`` (question, options, duration_seconds, ends_at) with error, options numbered from 1, and end.

    The first fault counts: question, number of options, first empty option, end.  A given end must lie
    ahead even if a duration is given too.
    """
    texts = F.transform("options", lambda t: F.coalesce(t, F.lit("")))  # a missing text is an empty one
    empty = F.array_position(texts, F.lit(""))
    bad_end = F.when(F.col("ends_at").isNotNull(), F.col("ends_at") <= now).otherwise(F.coalesce(F.col("duration_seconds") <= 0, F.lit(True)))
    error = (
        F.when(F.coalesce(F.col("question"), F.lit("")) == "", "question is required")
        .when(F.coalesce(F.size("options"), F.lit(0)) < 2, "at least two options are required")
        .when(empty > 0, F.concat(F.lit("option "), (empty - 1).cast("string"), F.lit(" is empty")))
        .when(bad_end, F.when(F.col("ends_at").isNotNull(), "ends_at is in the past").otherwise("duration_seconds or ends_at is required"))
    )
    end = F.coalesce("ends_at", now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("duration_seconds")))
    numbered = F.transform("options", lambda t, i: F.struct((i + 1).cast("int").alias("id"), t.alias("text")))
    return requests.withColumn("error", error).withColumns({"ends_at": F.when(error.isNull(), end), "options": F.when(error.isNull(), numbered)})
