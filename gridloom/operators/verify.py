"""Verification of published metrics as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.axis import N_LABELS, code_of_label
from gridloom.sources import footer

KEYS = ("trade_date", "minute", "symbol")
#: Tolerances of chain checks; integers are always exact.
CHAIN_RTOL, CHAIN_ATOL = 1e-10, 1e-8


@dataclass(frozen=True)
class DayReference:
    """An independent computation of expected values: ``function`` gets the inputs and returns KEYS plus the metrics."""

    function: Callable[[dict[str, DataFrame]], DataFrame]
    identity: str
    rtol: float = 0.0
    atol: float = 0.0
    level: str = "full"

    def __post_init__(self) -> None:
        if self.level not in {"light", "full"}:
            raise ValueError(f"level must be light or full: {self.level}")
        if self.rtol < 0 or self.atol < 0:
            raise ValueError("tolerances must not be negative")


def schema_problems(df: DataFrame, expected: Sequence[tuple[str, str, bool]]) -> list[str]:
    """Names, order, types and nullability (name, type, nullable); empty if all agree."""
    got = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    out = []
    if [g[0] for g in got] != [e[0] for e in expected]:
        return [f"columns {[g[0] for g in got]}, expected {[e[0] for e in expected]}"]
    for g, e in zip(got, expected, strict=True):
        if g[1] != e[1]:
            out.append(f"{g[0]}: {g[1]}, expected {e[1]}")
        if g[2] and not e[2]:
            out.append(f"{g[0]} may be null")
    return out


def structure(published: DataFrame, n_labels: int = N_LABELS) -> DataFrame:
    """C2 per day: ``trade_date, n_rows, n_symbols, n_cells, complete``; complete: every symbol times label exactly once.

    A balanced repeat and gap leaves the row count right but not the number of distinct cells.
    """
    per_cell = published.groupBy("trade_date", "symbol", "minute").agg(F.count(F.lit(1)).alias("n"))
    per_symbol = per_cell.groupBy("trade_date", "symbol").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
    days = per_symbol.groupBy("trade_date").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_symbols"), F.sum("cells").alias("n_cells"))
    full = F.col("n_symbols") * n_labels
    return days.withColumn("complete", (F.col("n_rows") == full) & (F.col("n_cells") == full))


def grid_problems(published: DataFrame, n_labels: int = N_LABELS) -> DataFrame:
    """C5 per (trade_date, symbol) with a fault: ``n_rows, n_codes, n_off_axis, n_wrong_date``; complete symbols give no row."""
    code = code_of_label(F.col("minute"))
    checked = published.select("trade_date", "symbol", code.alias("code"), (F.to_date("minute") != F.col("trade_date")).alias("wrong"))
    per = checked.groupBy("trade_date", "symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("code") >= 0, F.col("code"))).alias("n_codes"), F.count(F.when(F.coalesce(F.col("code"), F.lit(-1)) < 0, 1)).alias("n_off_axis"), F.count(F.when(F.col("wrong"), 1)).alias("n_wrong_date")
    )
    return per.where((F.col("n_rows") != n_labels) | (F.col("n_codes") != n_labels) | (F.col("n_off_axis") > 0) | (F.col("n_wrong_date") > 0))


def compare(expected: DataFrame, actual: DataFrame, metric: str, rtol: float = 0.0, atol: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keyed full outer join; a row per differing cell: ``keys..., expected, actual, problem``.

    ``missing`` and ``extra`` cells, ``null`` against a value, ``non_finite`` values, ``differs``. Integers are exact whatever the
    tolerances; doubles may differ by atol + rtol * |expected|. Repeated keys in either side give ``repeated``.
    """
    kind = expected.schema[metric].dataType
    floating = isinstance(kind, (T.DoubleType, T.FloatType))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__n_{name}"), F.max(F.struct(F.col(metric).alias("v")))["v"].alias(name))

    joined = side(expected, "expected").join(side(actual, "actual"), list(keys), "full")
    e, a = F.col("expected"), F.col("actual")
    bad: Column
    if floating:
        bad = F.abs(e - a) > F.lit(atol) + F.lit(rtol) * F.abs(e)
        infinite = F.isnan(a) | (F.abs(a) == float("inf"))
    else:
        bad, infinite = e != a, F.lit(False)
    problem = (
        F.when(F.col("__n_actual").isNull(), "missing")
        .when(F.col("__n_expected").isNull(), "extra")
        .when((F.col("__n_actual") > 1) | (F.col("__n_expected") > 1), "repeated")
        .when(e.isNull() != a.isNull(), "null")
        .when(infinite, "non_finite")
        .when(bad, "differs")
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*keys, "expected", "actual", "problem")


def compare_summary(expected: DataFrame, actual: DataFrame, metric: str, rtol: float = 0.0, atol: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells of each problem, ``problem, n, max_abs_error``."""
    d = compare(expected, actual, metric, rtol, atol, keys)
    return d.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("expected").cast("double") - F.col("actual").cast("double"))).alias("max_abs_error"))


def unordered_rows(df: DataFrame, position: str) -> DataFrame:
    """O1: days whose rows, by ``position`` in the file, are not in order of minute and symbol; ``trade_date, n_unordered``."""
    from pyspark.sql import Window

    w = Window.partitionBy("trade_date").orderBy(position)
    here, before = F.struct("minute", "symbol"), F.lag(F.struct("minute", "symbol")).over(w)
    return df.withColumn("__bad", before.isNotNull() & (before >= here)).groupBy("trade_date").agg(F.count(F.when(F.col("__bad"), 1)).alias("n_unordered")).where("n_unordered > 0")


def validate_published(published: dict[str, DataFrame], expected: dict[str, DataFrame], reference: DayReference) -> dict[str, dict[str, int]]:
    """C4: problems per metric and kind; no metric at all is an error, and so is one without expectation."""
    if not published:
        raise ValueError("nothing to validate")
    out = {}
    for metric, df in published.items():
        if metric not in expected:
            raise ValueError(f"{metric} has no expected values")
        found = {r.problem: r.n for r in compare_summary(expected[metric], df, metric, reference.rtol, reference.atol).collect()}
        incomplete = structure(df).where(~F.col("complete")).count()
        if incomplete:
            found["incomplete_days"] = incomplete
        out[metric] = found
    return out


def preflight(df: DataFrame, symbols: Sequence[str], day: str) -> DataFrame:
    """An input day against its fixed universe: ``n_rows, n_missing_symbols, n_extra_symbols, n_wrong_dates``."""
    wanted = df.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    have = df.select("symbol").distinct()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("trade_date") != F.lit(day).cast("date"), 1)).alias("n_wrong_dates")).select(
        "n_rows",
        F.lit(wanted.join(have, "symbol", "left_anti").count()).alias("n_missing_symbols"),
        F.lit(have.join(wanted, "symbol", "left_anti").count()).alias("n_extra_symbols"),
        "n_wrong_dates",
    )


def preflight_days(inputs: dict[str, DataFrame]) -> DataFrame:
    """C7 over every day of several tables: ``table_name, trade_date, n_rows, n_null_symbols, n_missing_symbols, n_extra_symbols, n_wrong_dates``.

    A table's universe of a day is what the other tables hold: their symbols that it lacks are missing, its own that none of them
    has are extra, and rows of a day that none of them has (a null one included) are of a wrong date. A row per table and day of any table.
    """
    if len(inputs) < 2:
        raise ValueError("one table has no others to be held against")
    cells = None
    for name, df in inputs.items():
        part = df.groupBy("trade_date", "symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(name))
        cells = part if cells is None else cells.unionByName(part)
    count = {name: F.coalesce(F.sum(F.when(F.col("t") == name, F.col("n"))), F.lit(0)).alias(f"n_{i}") for i, name in enumerate(inputs)}
    per_symbol = cells.groupBy("trade_date", "symbol").agg(*count.values())
    known, sums = F.col("symbol").isNotNull(), []
    for i in range(len(inputs)):
        own, others = F.col(f"n_{i}"), sum((F.col(f"n_{k}") for k in range(len(inputs)) if k != i), F.lit(0))
        sums.append(F.struct(
            F.sum(own).alias("n_rows"), F.sum(F.when(known, F.lit(0)).otherwise(own)).alias("n_null_symbols"), F.count(F.when(known & (own == 0), 1)).alias("n_missing_symbols"),
            F.count(F.when(known & (own > 0) & (others == 0), 1)).alias("n_extra_symbols"), F.when(F.col("trade_date").isNull() | (F.sum(others) == 0), F.sum(own)).otherwise(F.lit(0)).alias("n_wrong_dates"),
        ).alias(f"s_{i}"))
    days = per_symbol.groupBy("trade_date").agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("table_name"), F.col(f"s_{i}").alias("s")) for i, name in enumerate(inputs)]))
    return days.select("trade_date", rows.alias("r")).select("r.table_name", "trade_date", "r.s.*")


#: File keys and Arrow types of an input; of several names of a column the first that is there counts.
INPUT_KEYS = {"price_policy_version": "3", "format_version": "1"}
INPUT_TYPES = {("symbol",): "string", ("date", "trade_date"): "date32[day]"}


def footer_faults(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """File keys and types other than the input contract's, over the footers of all files: ``field, expected, found, n_files``; a missing one is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with footer.open_file(path) as f:
                    schema = pq.read_schema(f)
                meta = schema.metadata or {}
                got = [(k, want, meta[k.encode()].decode("utf-8", "replace") if k.encode() in meta else None) for k, want in INPUT_KEYS.items()]
                for names, want in INPUT_TYPES.items():
                    have = next((n for n in names if n in schema.names), None)
                    got.append((names[0], want, str(schema.field(have).type) if have else None))
                rows += [g for g in got if g[1] != g[2]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["field", "expected", "found"])

    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))
    return paths.mapInArrow(read, "field string, expected string, found string").groupBy("field", "expected", "found").agg(F.count(F.lit(1)).alias("n_files"))
