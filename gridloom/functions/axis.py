"""The 242-label minute axis as native Column expressions (inventory D5, F1-F5).

Labels name the *end* of an interval: 09:30-11:30 (codes 0..120) and 13:00-15:00 (codes 121..241). Intervals are
left-open and right-closed, with three folds: pre-market into code 0, 11:29-11:31 into 120, 12:59-13:00 into 121.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE_MS = 60_000
DAY_MS = 86_400_000
N_LABELS = 242
OPEN_MS = 34_200_000  # 09:30
NOON_MS = 41_400_000  # 11:30
REOPEN_MS = 46_800_000  # 13:00
CLOSE_MS = 54_000_000  # 15:00
MORNING_LABELS = 121
TIMEZONE = "Asia/Shanghai"


def minute_code_unchecked(time_ms: Column, pre_market: bool = True, post_market: bool = False) -> Column:
    """Code 0..241 of milliseconds since midnight, -1 off the axis; NULL for NULL. Times outside the day give -1."""
    t = time_ms.cast("long")
    before = F.lit(0) if pre_market else F.when(t == OPEN_MS, 0).otherwise(-1)
    after = F.lit(N_LABELS - 1 if post_market else -1)
    morning = F.floor((t - (OPEN_MS - MINUTE_MS + 1)) / MINUTE_MS)
    afternoon = F.floor((t - (REOPEN_MS - MINUTE_MS + 1)) / MINUTE_MS) + MORNING_LABELS
    return (
        F.when(t.isNull(), F.lit(None))
        .when((t < 0) | (t >= DAY_MS), F.lit(-1))
        .when(t <= OPEN_MS, before)
        .when(t <= NOON_MS - MINUTE_MS, morning)
        .when(t <= NOON_MS + MINUTE_MS, F.lit(120))
        .when(t < REOPEN_MS - MINUTE_MS, F.lit(-1))
        .when(t <= REOPEN_MS, F.lit(121))
        .when(t <= CLOSE_MS - MINUTE_MS, afternoon)
        .when(t <= CLOSE_MS, F.lit(N_LABELS - 1))
        .otherwise(after)
        .cast("int")
    )


def minute_code(time_ms: Column, pre_market: bool = True, post_market: bool = False) -> Column:
    """As :func:`minute_code_unchecked`, but NULL or a time outside the day raises (F2)."""
    t = time_ms.cast("long")
    return F.when(
        t.isNull() | (t < 0) | (t >= DAY_MS),
        F.raise_error(F.concat(F.lit("time_ms outside the day: "), F.coalesce(t.cast("string"), F.lit("null")))).cast("int"),
    ).otherwise(minute_code_unchecked(t, pre_market, post_market))


def minute_of_day(code: Column) -> Column:
    """Minute of the day that a code's label names."""
    return F.when(code < MORNING_LABELS, code + OPEN_MS // MINUTE_MS).otherwise(code + (REOPEN_MS // MINUTE_MS - MORNING_LABELS))


def minute_label(code: Column, trade_date: Column) -> Column:
    """Interval-end label as a timestamp without zone in exchange time; NULL for -1 or NULL."""
    label = trade_date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute_of_day(code).cast("int"), F.lit(0))
    return F.when((code >= 0) & (code < N_LABELS), label)


def code_of_label(label: Column) -> Column:
    """Inverse of :func:`minute_label`; -1 for a timestamp that is no label."""
    minute = F.hour(label) * 60 + F.minute(label)
    whole = (F.second(label) == 0) & (F.date_trunc("minute", label) == label)
    return (
        F.when(whole & minute.between(570, 690), minute - 570)
        .when(whole & minute.between(780, 900), minute - 780 + MORNING_LABELS)
        .otherwise(-1)
        .cast("int")
    )


def time_ms_of(value: Column, kind: str) -> Column:
    """Milliseconds since midnight of an integer, a timestamp (floored; F5) or a day-time interval (rounded)."""
    if kind in {"timestamp", "timestamp_ntz"}:
        # seconds come with their fraction as a decimal: exact, and floored to the millisecond
        return F.hour(value) * F.lit(3_600_000).cast("long") + F.minute(value) * 60_000 + F.floor(F.extract(F.lit("SECOND"), value) * 1000).cast("long")
    if kind.startswith("interval day"):
        return F.round(F.expr("1") * (F.extract(F.lit("DAY"), value) * DAY_MS + F.extract(F.lit("HOUR"), value) * 3_600_000 + F.extract(F.lit("MINUTE"), value) * 60_000 + F.extract(F.lit("SECOND"), value) * 1000)).cast("long")
    return value.cast("long")


def timestamp_minute_code(value: Column, zoned: bool = False, pre_market: bool = True, post_market: bool = False) -> Column:
    """Code of a timestamp (F3): without zone it is exchange-local; ``zoned`` instants are moved to the exchange's zone."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(value, F.current_timezone()), TIMEZONE) if zoned else value
    return minute_code(time_ms_of(local, "timestamp"), pre_market, post_market)


def axis_position(time_ms: Column, code: Column) -> Column:
    """Milliseconds of a reading relative to its label, folded into (-60000, 0]; the local coordinate of one axis cell."""
    e = time_ms.cast("long") - minute_of_day(code).cast("long") * MINUTE_MS
    return F.greatest(F.lit(1 - MINUTE_MS).cast("long"), F.least(F.lit(0).cast("long"), e))


def axis(spark: SparkSession) -> DataFrame:
    """The axis as a 242-row table (minute_code, minute_of_day)."""
    return spark.range(N_LABELS).select(F.col("id").cast("int").alias("minute_code")).withColumn("minute_of_day", minute_of_day(F.col("minute_code")))
