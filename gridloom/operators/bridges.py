"""Python bridges for reducers that Columns cannot express (A13, X3, X5): one call per cell, or per symbol and day."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.axis import N_LABELS
from gridloom.operators.metric import CELL


def reduce_cells(events: DataFrame, function: Callable[[pd.DataFrame], float | int | None], name: str, kind: str) -> DataFrame:
    """``function`` gets the rows of one cell and returns its value. A cell is one symbol's minute, so a group stays small;
    prefer an aggregate Column wherever one exists."""
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join([*[f"{c} {fields[c]}" for c in CELL], f"{name} {kind}"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, function(pdf))], columns=[*CELL, name])

    return events.groupBy(*CELL).applyInPandas(run, schema)


def compute_blocks(events: DataFrame, columns: list[str], function: Callable[[dict[str, np.ndarray]], dict[str, tuple[np.ndarray, np.ndarray]]], metrics: dict[str, str]) -> DataFrame:
    """``function`` gets one symbol-day as read-only numpy arrays sorted by minute (with ``minute_code``), and returns for
    every metric (codes, values). Checked (P15): exactly the declared metrics, 1-D integer codes in range, no code twice.

    A symbol-day is the unit of work by contract and is held whole in one task; for skewed symbols use aggregate Columns.
    """
    wanted = [*CELL, *columns]
    schema = "trade_date date, symbol string, minute_code int, " + ", ".join(f"{m} {t}" for m, t in metrics.items())
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}

    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("minute_code").to_numpy(), kind="stable")
        block = {c: table.column(c).to_numpy(zero_copy_only=False)[order] for c in ["minute_code", *columns]}
        for a in block.values():
            a.flags.writeable = False
        found = function(block)
        if set(found) != set(metrics):
            raise ValueError(f"block returned {sorted(found)}, declared are {sorted(metrics)}")
        dense: dict[str, list] = {}
        codes_seen: set[int] = set()
        for m, (codes, values) in found.items():
            codes = np.asarray(codes)
            if codes.ndim != 1 or codes.dtype.kind not in "iu" or len(codes) != len(values) or len(np.unique(codes)) != len(codes) or (len(codes) and (codes.min() < 0 or codes.max() >= N_LABELS)):
                raise ValueError(f"{m}: bad cell keys")
            dense[m] = dict(zip(codes.tolist(), values.tolist() if hasattr(values, "tolist") else list(values), strict=True))
            codes_seen |= set(codes.tolist())
        codes = sorted(codes_seen)
        columns_out = {"trade_date": pa.array([keys[0].as_py()] * len(codes), pa.date32()), "symbol": pa.array([keys[1].as_py()] * len(codes), pa.string()), "minute_code": pa.array(codes, pa.int32())}
        for m, t in metrics.items():
            columns_out[m] = pa.array([_none(dense[m].get(c)) for c in codes], arrow[t])
        return pa.table(columns_out)

    return events.select(*wanted).where(F.col("minute_code") >= 0).groupBy("trade_date", "symbol").applyInArrow(run, schema)


def _none(v: object) -> object:
    return None if isinstance(v, float) and v != v else v

