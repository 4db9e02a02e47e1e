"""Scans of day files into logical tables.

Scales, type codes and the price policy are in each file's footer, which Spark's reader does not show. Footers are read
first; files of equal metadata share one scan, scans are joined by ``unionByName``, and only the physical columns behind
the requested logical ones are read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import normalize
from gridloom.functions.axis import time_ms_of
from gridloom.sources import footer
from gridloom.sources.paths import check_dataset, input_path, iso

UNSIGNED = ("volume", "order_num", "buy_order_num", "sell_order_num")
SCALED = {"price": "price_scale", "money": "money_scale"}


def physical_columns(logical: Sequence[str], available: Sequence[str], dataset: str) -> dict[str, tuple[str, ...]]:
    """S3: the physical columns behind each requested one, in order, without repeats.

    ``trade_date`` is ``date``, ``time_ms`` is ``time``, ``timestamp`` is both; ``money`` of orders and cancels is derived from
    price and volume where the file has none, but never for trades. An empty request or an unknown column is an error.
    """
    if not logical:
        raise ValueError("no columns requested")
    have, out = set(available), {}
    for name in dict.fromkeys(logical):
        direct = {"trade_date": ("date",), "time_ms": ("time",), "timestamp": ("date", "time")}.get(name, (name,))
        if name in have and name in ("trade_date", "time_ms"):
            direct = (name,)
        if name == "timestamp":
            direct = ("date" if "date" in have else "trade_date", "time" if "time" in have else "time_ms")
        if name == "money" and "money" not in have:
            if dataset == "chengjiao":
                raise ValueError("trades without physical money: it is never recomputed")
            direct = ("price", "volume")
        missing = [c for c in direct if c not in have]
        if missing:
            raise ValueError(f"{dataset}: no column {', '.join(missing)} for {name}")
        out[name] = direct
    return out


def field_info(path: str | Path, logical: Sequence[str], dataset: str) -> dict[str, dict[str, object]]:
    """Physical type, scale and whether values were made by dividing by that scale; derived money has the type ``derived``."""
    with footer.open_file(str(path)) as f:
        schema = pq.read_schema(f)
    meta = {k.decode(): v for k, v in (schema.metadata or {}).items()}
    out: dict[str, dict[str, object]] = {}
    for name, sources in physical_columns(logical, schema.names, check_dataset(dataset)).items():
        if name == "money" and sources != ("money",):
            out[name] = {"physical_type": "derived", "scale": None, "normalized": False}
            continue
        kind = schema.field(sources[-1] if name == "timestamp" else sources[0]).type  # of a timestamp: the time's
        scale = int(meta[SCALED[name]]) if SCALED.get(name) in meta and pa.types.is_integer(kind) else None
        out[name] = {"physical_type": str(kind), "scale": scale, "normalized": scale is not None}
    return out


def field_infos(spark: SparkSession, files: Sequence[str], logical: Sequence[str], dataset: str) -> DataFrame:
    """S4 over all files, read on the executors: ``column_name, physical_type, scale, normalized``, once for each way it occurs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, i["physical_type"], i["scale"], i["normalized"]) for path in batch.column(0).to_pylist() for c, i in field_info(path, logical, dataset).items()]
            types = (pa.string(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["column_name", "physical_type", "scale", "normalized"])

    return footer.file_table(spark, files).mapInArrow(read, "column_name string, physical_type string, scale int, normalized boolean").distinct()


def check_price_policy(path: str | Path, wanted: str | None) -> None:
    """The file must be written under the price policy a metric asks for."""
    if wanted is None:
        return
    got = footer.key_values(str(path)).get("price_policy_version")
    if got != str(wanted):
        raise ValueError(f"{path}: price policy {got}, the metric needs {wanted}")


def logical_columns(df: DataFrame, logical: Sequence[str], dataset: str, meta: dict[str, str]) -> DataFrame:
    """One file group's physical columns as logical ones, in the requested order."""
    types, kinds = physical_columns(logical, df.columns, dataset), dict(df.dtypes)

    def column(name: str) -> Column:
        sources = types[name]
        c, kind = F.col(sources[0]), kinds[sources[0]]
        if name == "symbol":
            return normalize.decode_text(c, kind)
        if name == "trade_date":
            return c.cast("date")
        if name == "time_ms":
            return _day_ms(time_ms_of(c, kind))
        if name == "timestamp":
            ms = _day_ms(time_ms_of(F.col(sources[1]), kinds[sources[1]]))
            return c.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / 1000).cast("decimal(18,6)"))
        if name in SCALED:
            if sources != (name,):
                return normalize.derived_money(_scaled("price", kinds["price"], meta), normalize.unsigned(F.col("volume"), kinds["volume"], f"{dataset}.volume"))
            return _scaled(name, kind, meta)
        if name in UNSIGNED:
            return normalize.unsigned(c, kind, f"{dataset}.{name}")
        if name == "type":
            if "type_encoding" not in meta:
                raise ValueError(f"{dataset}: file has no type_encoding")
            return normalize.decode_type(c, meta["type_encoding"])
        return c

    return df.select(*[column(n).alias(n) for n in types])


def _scaled(name: str, kind: str, meta: dict[str, str]) -> Column:
    scale = meta.get(SCALED[name])
    return normalize.unscale(F.col(name), kind, int(scale) if scale is not None else None, name)


def _day_ms(ms: Column) -> Column:
    bad = ms.isNull() | (ms < 0) | (ms >= 86_400_000)
    return normalize.guard(ms, bad, "time_ms outside the day", "bigint")


def read_files(spark: SparkSession, paths: Sequence[str], dataset: str, logical: Sequence[str], price_policy: str | None = None) -> DataFrame:
    """Logical columns of many files: one scan per group of equal metadata and schema."""
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        check_price_policy(p, price_policy)
        with footer.open_file(str(p)) as f:
            meta = pq.read_metadata(f)
        schema = meta.schema.to_arrow_schema()
        keys = tuple(sorted((k.decode(), v.decode("utf-8", "replace")) for k, v in (meta.metadata or {}).items() if k != b"ARROW:schema"))
        groups.setdefault((keys, tuple((n, str(t)) for n, t in zip(schema.names, schema.types, strict=True))), []).append(str(p))
    out = None
    for (keys, _), files in groups.items():
        part = logical_columns(spark.read.parquet(*files), logical, check_dataset(dataset), dict(keys))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no files of {dataset}")
    return out


def read_days(spark: SparkSession, root: str | Path, dataset: str, days: Sequence[int | str | dt.date], logical: Sequence[str], price_policy: str | None = None) -> DataFrame:
    """Requested logical columns of whole days. A file whose date is not its name's raises when the date is used."""
    if not logical:
        raise ValueError("no columns requested")
    by_day = {iso(d): input_path(root, dataset, d) for d in days}
    missing = [str(p) for p in by_day.values() if not p.exists()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    wanted = list(dict.fromkeys([*logical, "trade_date"]))
    parts = read_files(spark, [str(p) for p in by_day.values()], dataset, wanted, price_policy)
    known = F.col("trade_date").isin([dt.date.fromisoformat(d) for d in by_day])
    checked = parts.withColumn("trade_date", F.when(known, F.col("trade_date")).otherwise(F.raise_error(F.lit(f"{dataset}: a file holds another date than its name")).cast("date")))
    return checked.select(*dict.fromkeys(logical))


def row_count(paths: Sequence[str]) -> int:
    """Rows from footers only."""
    return sum(footer.row_count(str(p)) for p in paths)
