"""Parquet footers and dictionary pages, read on the executors (inventory S4, S7, P13; problem 5).

Footers hold row counts, null counts and extrema of every column chunk; a dictionary page holds the distinct values of
a chunk if no data page fell back to plain encoding. Both are read without touching data pages' contents.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

DICTIONARY_ENCODINGS = {2, 8}  # fixed values of the format: PLAIN_DICTIONARY, RLE_DICTIONARY
INTEGERS = {"INT32", "INT64"}


def open_file(path: str) -> pa.NativeFile:
    """Opens a path or URI of any file system that pyarrow knows."""
    from urllib.parse import unquote

    from pyarrow import fs

    if path.startswith("file:"):
        path = unquote(path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:"))
    if "://" in path:
        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return fs.LocalFileSystem().open_input_file(path)


def file_table(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Files as a table of one column ``path``, spread so that each task reads a few footers."""
    df = spark.createDataFrame([(f,) for f in files], "path string")
    return df.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))


def key_values(path: str) -> dict[str, str]:
    """Key/value metadata of a file: scales, encodings, policy version."""
    with open_file(path) as f:
        raw = pq.read_metadata(f).metadata or {}
    return {k.decode(): v.decode("utf-8", "replace") for k, v in raw.items() if k != b"ARROW:schema"}


def row_count(path: str) -> int:
    with open_file(path) as f:
        return pq.read_metadata(f).num_rows


class _Thrift:
    """Just enough of the compact protocol to read a page header."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int) -> object:
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return self.data[self.at - 1]
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            if self.at > len(self.data):
                raise IndexError
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 != 15 else self.varint()
            return [self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"compact type {kind}")

    def struct(self) -> dict[int, object]:
        out, last = {}, 0
        while True:
            head = self.data[self.at]
            self.at += 1
            if head == 0:
                return out
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            out[last] = self.value(head & 15)


def _page_header(f: pa.NativeFile, at: int, end: int) -> tuple[dict[int, object], int]:
    """The header of the page at an offset, and its length; statistics inside headers can be long, so read more if needed."""
    size = 256
    while True:
        f.seek(at)
        thrift = _Thrift(f.read(min(size, end - at)))
        try:
            return thrift.struct(), thrift.at
        except IndexError:
            if size >= end - at:
                raise
            size *= 8


def dictionary_values(f: pa.NativeFile, column: pq.ColumnChunkMetaData) -> np.ndarray | list | None:
    """The distinct non-null values of a chunk from its dictionary page; None where data pages use other encodings too."""
    if not column.has_dictionary_page or column.dictionary_page_offset is None:
        return None
    at = column.dictionary_page_offset
    end = at + column.total_compressed_size
    values, seen = None, 0
    while at < end and seen < column.num_values:
        header, length = _page_header(f, at, end)
        kind, raw_size, size = header[1], header[2], header[3]
        if kind == 2:
            f.seek(at + length)
            body = f.read(size)
            if column.compression != "UNCOMPRESSED":
                body = pa.Codec(column.compression.lower()).decompress(body, raw_size)
            values = _plain(column.physical_type, bytes(body), header[7][1])
        elif kind in (0, 3):
            data = header[5] if kind == 0 else header[8]
            if data[2 if kind == 0 else 4] not in DICTIONARY_ENCODINGS:
                return None
            seen += data[1]
        at += length + size
    return values


def _plain(kind: str, body: bytes, n: int) -> np.ndarray | list | None:
    if kind in {"INT32", "INT64", "FLOAT", "DOUBLE"}:
        return np.frombuffer(body, {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}[kind], n)
    if kind == "BYTE_ARRAY":
        out, at = [], 0
        for _ in range(n):
            (length,) = struct.unpack_from("<I", body, at)
            out.append(body[at + 4 : at + 4 + length])
            at += 4 + length
        return out
    return None


def as_text(value: object) -> str | None:
    """A statistic or dictionary entry as Spark would print it; None for what cannot be printed alike."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (bytes, bytearray)):
        return value.decode("utf-8", "replace")
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (str, dt.date)):
        return str(value)
    return None


def chunks(path: str) -> Iterator[tuple[int, int, pq.ColumnChunkMetaData]]:
    """(row group, its rows, column chunk) of every chunk of a file."""
    with open_file(path) as f:
        meta = pq.read_metadata(f)
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            yield g, group.num_rows, group.column(c)


def column_ranges(spark: SparkSession, files: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``path``, and ``low_<c>, high_<c>`` of each column as text: extrema over all chunks of a file, null where a footer lacks them or counts nulls."""
    wanted = list(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[str | None]] = []
            for path in batch.column(0).to_pylist():
                found: dict[str, list] = {c: [] for c in wanted}
                for _, _, chunk in chunks(path):
                    if chunk.path_in_schema in found:
                        s = chunk.statistics
                        found[chunk.path_in_schema].append((s.min, s.max) if s is not None and s.has_min_max and s.has_null_count and not s.null_count else None)
                row: list[str | None] = [path]
                for c in wanted:
                    whole = bool(found[c]) and None not in found[c]
                    row += [as_text(min(x[0] for x in found[c])), as_text(max(x[1] for x in found[c]))] if whole else [None, None]
                out.append(row)
            names = ["path", *[f"{e}_{c}" for c in wanted for e in ("low", "high")]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(len(names))], names=names)

    schema = ", ".join(["path string", *[f"`{e}_{c}` string" for c in wanted for e in ("low", "high")]])
    return file_table(spark, files).mapInArrow(read, schema)


def row_counts(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``path, n_rows`` from footers only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row_count(p) for p in batch.column(0).to_pylist()], pa.int64())], names=["path", "n_rows"])

    return file_table(spark, files).mapInArrow(read, "path string, n_rows bigint")
