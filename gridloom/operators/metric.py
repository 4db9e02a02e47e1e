"""Dense minute metrics: declaration, shared aggregation, densification.

A metric is an aggregate Column over prepared events. Metrics that read the same inputs share one aggregation. The result
is dense: every symbol of the day's *unfiltered* inputs has all 242 labels. A label without events gets the metric's
``empty_value``; a label whose events have no known value is null, whatever the empty value is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.axis import N_LABELS, minute_code_unchecked, minute_label

NAME = re.compile(r"[a-z][a-z0-9]*(_[a-z0-9]+)*_min")
TYPES = {"int64": "bigint", "uint64": "decimal(20,0)", "float64": "double"}
CELL = ("trade_date", "symbol", "minute_code")


@dataclass(frozen=True)
class MetricSpec:
    """``aggregate``: builds the Column that reduces a cell's events; ``empty_value``: of a cell without events, None is null."""

    name: str
    aggregate: Callable[[], Column]
    value_type: str = "int64"
    empty_value: float | int | None = 0
    inputs: tuple[str, ...] = ("chengjiao",)
    price_policy: str | None = None

    def __post_init__(self) -> None:
        if not NAME.fullmatch(self.name):
            raise ValueError(f"metric name must be words of a-z and 0-9 ending in _min: {self.name}")
        if self.value_type not in TYPES:
            raise ValueError(f"{self.name}: unknown value type {self.value_type}")
        if self.value_type != "float64" and isinstance(self.empty_value, float):
            raise ValueError(f"{self.name}: an integer metric needs an integer empty value")
        if self.value_type == "uint64" and self.empty_value is not None and self.empty_value < 0:
            raise ValueError(f"{self.name}: empty value is negative")


@dataclass(frozen=True)
class MetricGroup:
    """Metrics over the same inputs: one preparation, one scan, one aggregation. ``prepare`` maps the inputs to events.

    An event without time is an error (P10); ``null_time="off_axis"`` takes tables known to hold such rows: they are then in
    no minute, like events outside the sessions, and still open their symbol's grid.
    """

    metrics: tuple[MetricSpec, ...]
    prepare: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    include_pre_market: bool = True
    include_post_market: bool = False
    null_time: str = "raise"
    cell_columns: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.metrics:
            raise ValueError("a group needs a metric")
        if self.null_time not in {"raise", "off_axis"}:
            raise ValueError(f"null_time must be raise or off_axis: {self.null_time}")
        names = [m.name for m in self.metrics]
        if len(set(names)) != len(names):
            raise ValueError(f"repeated metric names {names}")
        if len({frozenset(m.inputs) for m in self.metrics}) != 1:
            raise ValueError("metrics of a group must declare the same inputs")


def universe(inputs: Sequence[DataFrame]) -> DataFrame:
    """(trade_date, symbol) of all declared inputs, unfiltered; null symbols are no symbols. Each input is reduced before the union."""
    out = None
    for df in inputs:
        part = df.select("trade_date", "symbol").where(F.col("symbol").isNotNull()).distinct()
        out = part if out is None else out.unionByName(part)
    return out.distinct() if len(inputs) > 1 else out


def require_events(events: DataFrame) -> DataFrame:
    """P10: ``symbol`` must be there and not null; a null raises when used."""
    for c in ("trade_date", "symbol"):
        if c not in events.columns:
            raise ValueError(f"events need {c}")
    return events.withColumn("symbol", F.when(F.col("symbol").isNull(), F.raise_error(F.lit("event without symbol")).cast("string")).otherwise(F.col("symbol")))


def event_code(group: MetricGroup) -> Column:
    """Minute code of an event's ``time_ms``; a null time raises (P10) unless the group takes it as off the axis."""
    t = F.col("time_ms")
    code = minute_code_unchecked(t, group.include_pre_market, group.include_post_market)
    if group.null_time == "off_axis":
        return F.coalesce(code, F.lit(-1))
    return F.when(t.isNull(), F.raise_error(F.lit("event without time_ms")).cast("int")).otherwise(code)


def aggregate_minutes(events: DataFrame, group: MetricGroup, code: Column | None = None) -> DataFrame:
    """Sparse cells (D6) of all metrics in one aggregation; off-axis events are dropped."""
    c = event_code(group) if code is None else code
    on_axis = require_events(events).withColumn("minute_code", c).where(F.col("minute_code") >= 0)
    return on_axis.groupBy(*CELL).agg(*[_typed(m.aggregate(), m).alias(m.name) for m in group.metrics])


def _typed(value: Column, m: MetricSpec) -> Column:
    if m.value_type == "float64":
        d = value.cast("double")
        return F.when(~F.isnan(d), d)  # NaN never stands for a value
    return value.cast(TYPES[m.value_type])


def densify(sparse: DataFrame, days: DataFrame, empty: dict[str, object], n_labels: int = N_LABELS) -> DataFrame:
    """``days`` (trade_date, symbol) times the labels, with the sparse cells' values; ``empty``: value of a cell without events.

    No join: a day's marker row (code -1) meets the cells of its symbol-day, and in order of code every row opens the labels up
    to the next one. Only compact rows are shuffled, once and by (trade_date, symbol); the wide grid is made after that shuffle.
    Cells outside ``days`` or the axis are left out (P12, ``unknown_cells`` lists them); a repeated cell stays a repeated row (P11).
    """
    on_axis = sparse.where((F.col("minute_code") >= 0) & (F.col("minute_code") < n_labels)).select(*CELL, *empty)
    marked = on_axis.unionByName(days.select("trade_date", "symbol", F.lit(-1).alias("minute_code")), allowMissingColumns=True)
    known = F.min("minute_code").over(Window.partitionBy("trade_date", "symbol"))
    return _open_labels(marked.withColumn("__known", known).where("__known = -1"), empty, n_labels)


def _open_labels(cells: DataFrame, empty: dict[str, object], n_labels: int) -> DataFrame:
    """Cells and markers (code -1) as full grids. The first row of a symbol-day opens the labels before it, every row those up to the next."""
    w = Window.partitionBy("trade_date", "symbol").orderBy("minute_code")
    code, after = F.col("minute_code"), F.col("__next")
    start = F.when(F.col("__first"), 0).otherwise(F.greatest(code, F.lit(0)))
    stop = F.when(after.isNull(), n_labels - 1).when((after == code) & (code >= 0), code).otherwise(after - 1)
    spans = cells.select(*CELL, *empty, F.lead(code).over(w).alias("__next"), F.lag(code).over(w).isNull().alias("__first")).where(stop >= start)
    opened = spans.select("trade_date", "symbol", code.alias("__code"), *empty, F.explode(F.sequence(start, stop)).alias("minute_code"))
    types = dict(cells.dtypes)
    absent = (F.col("minute_code") != F.col("__code"))
    return opened.select(*CELL, *[F.when(absent, F.lit(empty[v]).cast(types[v])).otherwise(F.col(v)).alias(v) for v in empty])


def compute(inputs: dict[str, DataFrame], group: MetricGroup) -> DataFrame:
    """All metrics of a group over all days of the inputs, dense: ``trade_date, symbol, minute_code, <metrics>``.

    An empty input gives an empty result with the schema; days whose events are all off the axis give empty values. A group that
    takes its one input as it is reads it once: off-axis events form the marker cells that open their symbol-days.
    """
    names = group.metrics[0].inputs
    used = {n: inputs[n] for n in names}
    empty = {m.name: m.empty_value for m in group.metrics}
    if group.prepare is None:
        if len(used) > 1:
            raise ValueError("a group over several inputs needs prepare")
        events = require_events(used[names[0]]).withColumn("minute_code", event_code(group))
        return _open_labels(events.groupBy(*CELL).agg(*[_typed(m.aggregate(), m).alias(m.name) for m in group.metrics]), empty, N_LABELS)
    sparse = aggregate_minutes(group.prepare(used), group)
    return densify(sparse, universe(list(used.values())), empty)


def labelled(dense: DataFrame) -> DataFrame:
    """The published form: ``trade_date, minute, symbol, <metrics>`` with interval-end labels."""
    rest = [c for c in dense.columns if c not in CELL]
    return dense.select("trade_date", minute_label(F.col("minute_code"), F.col("trade_date")).alias("minute"), "symbol", *rest)


def repeated_cells(cells: DataFrame) -> DataFrame:
    """Cells that occur more than once."""
    return cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_cells(cells: DataFrame, days: DataFrame, n_labels: int = N_LABELS) -> DataFrame:
    """Cells of a symbol outside the universe or a code off the axis."""
    known = days.select("trade_date", "symbol")
    off = cells.where(F.col("minute_code").isNull() | (F.col("minute_code") < 0) | (F.col("minute_code") >= n_labels)).select(*CELL)
    return cells.select(*CELL).join(known, ["trade_date", "symbol"], "left_anti").unionByName(off).distinct()


def scatter(values: DataFrame, n: int, key: str, value: str, fill: object) -> DataFrame:
    """(key, value) into 0..n-1 with a fill; a key outside raises."""
    kind = dict(values.dtypes)[value]
    given = values.select(F.col(key).cast("bigint").alias("__k"), F.col(value).alias("__v"), F.lit(True).alias("__is"))
    base = values.sparkSession.range(n).select(F.col("id").alias("__id"))
    # A full join: the check looks at its result, so no filter of the input can be evaluated after it.
    joined = base.join(given, F.col("__id") == F.col("__k"), "full")
    out = F.when(F.col("__id").isNull(), F.raise_error(F.concat(F.lit("key out of range: "), F.coalesce(F.col("__k").cast("string"), F.lit("null")))).cast("bigint")).otherwise(F.col("__id"))
    return joined.select(out.alias(key), F.when(F.col("__is").isNull(), F.lit(fill).cast(kind)).otherwise(F.col("__v")).alias(value))


def group_to_rows(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Every row with its group's aggregates. Aggregates first and joins back, so a hot group is not gathered in one window."""
    renamed = [f"__g{i}" for i in range(len(keys))]
    groups = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, renamed, strict=True)]).agg(*[c.alias(n) for n, c in aggs.items()])
    on = None
    for k, n in zip(keys, renamed, strict=True):
        part = F.col(k).eqNullSafe(F.col(n))
        on = part if on is None else on & part
    return df.join(groups, on, "left").drop(*renamed)
