"""Published metrics: day partitions with refuse, resume and overwrite; manifests; single month files.

Layout: ``root/<metric>/month=YYYYMM/trade_date=YYYY-MM-DD/*.parquet``. Replacing a day touches only its folder (dynamic
partition overwrite), so nothing is merged or rewritten for days that did not change. ``export_month`` writes the strict
one-file form with footer keys where a consumer needs it.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.axis import TIMEZONE
from gridloom.sources import footer
from gridloom.sources.paths import date_text, iso, metric_root

CODECS = {"none", "snappy", "gzip", "zstd", "lz4", "brotli"}
LEVELLED = {"gzip", "zstd", "brotli"}


@dataclass(frozen=True)
class RunConfig:
    """Checked when made; ``overwrite_dates`` and ``resume`` exclude each other."""

    input_root: str
    output_root: str
    resume: bool = False
    overwrite_dates: bool = False
    compression: str = "snappy"
    compression_level: int | None = None
    files_per_day: int = 1
    dates: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.resume and self.overwrite_dates:
            raise ValueError("resume and overwrite_dates exclude each other")
        if not self.input_root or not self.output_root:
            raise ValueError("input_root and output_root are needed")
        if self.files_per_day < 1:
            raise ValueError("files_per_day must be positive")
        compression_options(self.compression, self.compression_level)
        for d in self.dates:
            date_text(d)


def compression_options(codec: str, level: int | None) -> dict[str, str]:
    """Writer options; a level only for codecs that have one."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec}")
    if level is not None and codec not in LEVELLED:
        raise ValueError(f"{codec} takes no level")
    out = {"compression": codec}
    if level is not None:
        out[f"parquet.compression.codec.{'zlib' if codec == 'gzip' else codec}.level"] = str(level)
    return out


def dates_of(table: DataFrame) -> DataFrame:
    """S8 over a published table: its days, ``trade_date``; a row without one raises."""
    day = F.when(F.col("trade_date").isNull(), F.raise_error(F.lit("published row without trade_date")).cast("date")).otherwise(F.col("trade_date"))
    return table.select(day.alias("trade_date")).distinct()


def published_dates(root: str, metric: str) -> list[str]:
    """Published days of a metric from its folders; none before the first publication."""
    base = metric_root(root, metric)
    return sorted(p.name.removeprefix("trade_date=").replace("-", "") for p in base.glob("month=*/trade_date=*") if any(p.glob("*.parquet")))


def pending_dates(requested: Sequence[str], published: Sequence[str], config: RunConfig) -> list[str]:
    """What is to be computed. By default a published day is an error, resume leaves it out, overwrite takes it again."""
    want = sorted({date_text(d) for d in requested})
    there = [d for d in want if d in set(published)]
    if there and not config.resume and not config.overwrite_dates:
        raise FileExistsError(f"already published: {', '.join(there)}")
    return [d for d in want if config.overwrite_dates or d not in set(published)]


def write_days(dense: DataFrame, root: str, metric: str, config: RunConfig) -> None:
    """One metric's days, ordered by minute and symbol inside each day's file (O1)."""
    spark = dense.sparkSession
    out = dense.select("trade_date", "minute", "symbol", F.col(metric)).withColumn("month", F.date_format("trade_date", "yyyyMM"))
    if config.files_per_day == 1:
        placed = out.repartition("trade_date")
    else:
        # ranges of minutes, so that one huge day is written by several tasks and its files follow each other in order
        placed = out.repartitionByRange(config.files_per_day * max(1, out.select("trade_date").distinct().count()), "trade_date", "minute", "symbol")
    writer = placed.sortWithinPartitions("trade_date", "minute", "symbol").write.mode("overwrite").partitionBy("month", "trade_date").option("partitionOverwriteMode", "dynamic")
    for k, v in compression_options(config.compression, config.compression_level).items():
        writer = writer.option(k, v)
    writer.parquet(str(metric_root(root, metric)))
    spark.catalog.refreshByPath(str(metric_root(root, metric)))


def read_metric(spark: SparkSession, root: str, metric: str) -> DataFrame:
    """A published metric: ``trade_date, minute, symbol, <metric>``."""
    return spark.read.parquet(str(metric_root(root, metric))).withColumn("trade_date", F.col("trade_date").cast("date")).select("trade_date", "minute", "symbol", metric)


def write_manifest(root: str, name: str, content: dict[str, object]) -> Path:
    """JSON put in place by a rename."""
    path = Path(root) / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(f".{name}.{uuid.uuid4().hex}.tmp")
    temporary.write_text(json.dumps(content, indent=1, sort_keys=True, default=str))
    os.replace(temporary, path)
    return path


def read_manifest(root: str, name: str) -> dict[str, object] | None:
    path = Path(root) / f"{name}.json"
    return json.loads(path.read_text()) if path.exists() else None


def source_identity(paths: Sequence[str]) -> dict[str, str]:
    """Size, time of change and footer digest of each source; equal before and after a run or nothing is published."""
    from gridloom.functions.normalize import digest_of

    out = {}
    for p in paths:
        s = os.stat(p)
        meta = footer.key_values(str(p))
        out[str(p)] = digest_of(str(s.st_size), str(s.st_mtime_ns), json.dumps(meta, sort_keys=True), str(footer.row_count(str(p))))
    return out


MONTH_TYPES = {"bigint": pa.int64(), "double": pa.float64(), "decimal(20,0)": pa.uint64()}


def month_schema(metric: str, value: pa.DataType) -> pa.Schema:
    """The strict published schema with its footer keys."""
    fields = [pa.field("trade_date", pa.date32(), False), pa.field("minute", pa.timestamp("ms", TIMEZONE), False), pa.field("symbol", pa.string(), False), pa.field(metric, value)]
    keys = {"framework": "gridloom", "format_version": "1", "interval": "1min", "minute_label": "end", "timezone": TIMEZONE, "metric_name": metric}
    return pa.schema(fields, metadata=keys)


def export_month(spark: SparkSession, root: str, metric: str, month: str, target: str, config: RunConfig) -> int:
    """One ordered file of a month in the strict form; rows written. Days are streamed one after another, so memory holds one day.

    Checked afterwards: rows, days in order, schema. The file appears by a rename.
    """
    df = read_metric(spark, root, metric)
    kind = dict(df.dtypes)[metric]
    schema = month_schema(metric, MONTH_TYPES[kind])
    days = [d for d in published_dates(root, metric) if d.startswith(month)]
    if not days:
        raise FileNotFoundError(f"{metric}: no day of {month}")
    path = Path(target)
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    rows = 0
    level = config.compression_level
    with pq.ParquetWriter(temporary, schema, compression=config.compression, compression_level=level, use_dictionary=["trade_date", "minute", "symbol"]) as writer:
        for d in days:
            part = df.where(F.col("trade_date") == F.lit(iso(d)).cast("date")).orderBy("minute", "symbol").withColumn("minute", F.col("minute").cast("timestamp_ntz")).toArrow()
            minute = part.column("minute").cast(pa.timestamp("ms"))
            import pyarrow.compute as pc

            value = part.column(metric).cast(MONTH_TYPES[kind])
            table = pa.Table.from_arrays([part.column("trade_date").cast(pa.date32()), pc.assume_timezone(minute, TIMEZONE), part.column("symbol").cast(pa.string()), value], schema=schema)
            writer.write_table(table)
            rows += table.num_rows
    written = pq.ParquetFile(temporary)
    if written.metadata.num_rows != rows or not rows or written.schema_arrow.remove_metadata() != schema.remove_metadata():
        temporary.unlink()
        raise ValueError(f"{metric} {month}: the written file fails its checks")
    os.replace(temporary, path)
    return rows


def remove_days(root: str, metric: str, days: Sequence[str]) -> None:
    """Takes published days away (repair)."""
    base = metric_root(root, metric)
    for d in map(date_text, days):
        shutil.rmtree(base / f"month={d[:6]}" / f"trade_date={iso(d)}", ignore_errors=True)
