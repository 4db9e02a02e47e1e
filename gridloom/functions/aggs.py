"""Aggregate Columns for minute cells (A3-A12, W1-W4). All but the path extremes are one hash aggregation, so many of
them share one pass; the path extremes add a window over the cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.normalize import U64_MAX

BUY, SELL = 49, 50


def sum_u64(value: Column) -> Column:
    """A3: exact sum of non-negative integers; a negative input or a sum beyond 2^64-1 raises; null for no value."""
    wide = value.cast("decimal(20,0)")
    total = F.sum(F.when(value < 0, F.raise_error(F.lit("negative value in an unsigned sum")).cast("decimal(20,0)")).otherwise(wide))
    return F.when(total > F.lit(str(U64_MAX)).cast("decimal(20,0)"), F.raise_error(F.lit("unsigned sum overflows")).cast("decimal(20,0)")).otherwise(total).cast("decimal(20,0)")


def sum_int(value: Column) -> Column:
    """A3 for sources up to uint32: bigint, overflow raises under ANSI."""
    return F.sum(value.cast("bigint"))


def sum_float(value: Column) -> Column:
    """A4: NaN and infinity raise, and so does an infinite sum; null values are skipped."""
    d = value.cast("double")
    total = F.sum(F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.raise_error(F.lit("not finite in a sum")).cast("double")).otherwise(d))
    return F.when(F.abs(total) == float("inf"), F.raise_error(F.lit("sum overflows")).cast("double")).otherwise(total)


def count_rows() -> Column:
    """A5."""
    return F.count(F.lit(1))


def min_value(value: Column) -> Column:
    """A6; NaN raises."""
    return F.min(value)


def max_value(value: Column) -> Column:
    """A7."""
    return F.max(value)


def first_value(value: Column, order: Sequence[str]) -> Column:
    """The value of the first row in the order, null values included; give a full order for a defined result."""
    return F.min_by(F.struct(value.alias("v")), F.struct(*order))["v"]


def last_value(value: Column, order: Sequence[str]) -> Column:
    """A9."""
    return F.max_by(F.struct(value.alias("v")), F.struct(*order))["v"]


def distinct_count(value: Column) -> Column:
    """A10: exact."""
    return F.count_distinct(value)


def time_centre(time_ms: Column, weight: Column | None = None, side: Column | None = None, which: int | None = None) -> Column:
    """Weighted mean of the seconds within the minute; hh:mm:00.000 is second 0 of the label that ends there. Null for no weight."""
    # in milliseconds and integers, divided once: the result does not depend on the order of rows
    ms = (time_ms % 60_000).cast("bigint")
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    if which is not None:
        w = F.when(side == which, w)
        ms = F.when(side == which, ms)
    total = F.sum(w)
    return F.sum(w * ms) / F.when(total != 0, total) / 1000.0


def side_sum(value: Column, side: Column, which: int = BUY) -> Column:
    """Sum over one side; 0, not null, where the cell has only the other side."""
    return F.coalesce(F.sum(F.when(side == which, value.cast("bigint"))), F.lit(0).cast("bigint"))


def entropy(value: Column) -> Column:
    """W2 in one pass: -sum p ln p = ln V - (sum v ln v) / V over positive v; null without any; never negative."""
    v = F.when(value > 0, value.cast("double"))
    total = F.sum(v)
    return F.when(F.count(v) > 0, F.greatest(F.lit(0.0), F.log(total) - F.sum(v * F.log(v)) / total))


def ohlc(price: Column, order: Sequence[str]) -> list[Column]:
    """Open, high, low, close of known prices in a full order."""
    key = F.when(price.isNotNull(), F.struct(*order))
    return [F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close")]


def path_extremes(df: DataFrame, cell: Sequence[str], order: Sequence[str], side: str, weights: dict[str, Column]) -> DataFrame:
    """Extremes of the signed cumulative path within each cell, ``cell..., <name>_buy, <name>_sell, <name>_abs``.

    Sign +1 for side 49, -1 for 50, else 0; an unknown weight moves the path by 0. buy = max(0, highest point), sell =
    max(0, -lowest point), abs = buy + sell. A weight with no known value in the cell gives null. The window's partition is a
    cell: one symbol's rows of one minute.
    """
    sign = F.when(F.col(side) == BUY, 1).when(F.col(side) == SELL, -1).otherwise(0)
    w = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    walked = df.select(*cell, *[F.sum(F.coalesce(c, F.lit(0)) * sign).over(w).alias(f"__p_{n}") for n, c in weights.items()], *[c.alias(f"__w_{n}") for n, c in weights.items()])
    out = []
    for n in weights:
        known = F.count(f"__w_{n}") > 0
        zero = F.lit(0)
        buy, sell = F.greatest(zero, F.max(f"__p_{n}")), F.greatest(zero, -F.min(f"__p_{n}"))
        out += [F.when(known, buy).alias(f"{n}_buy"), F.when(known, sell).alias(f"{n}_sell"), F.when(known, buy + sell).alias(f"{n}_abs")]
    return walked.groupBy(*cell).agg(*out)
