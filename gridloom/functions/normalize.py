"""Physical values to logical ones, with the strict checks of the data model.

A check is part of the value it guards: the guarded Column raises when a bad value is *used*, so column pruning can drop a
check only together with the column it protects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64_MAX = (1 << 64) - 1
INTEGER = {"tinyint", "smallint", "int", "bigint"}
MAX_SCALE = 1 << 53
MAX_RAW = 1 << 50


def guard(value: Column, bad: Column, message: str, kind: str) -> Column:
    """``value``, or an error naming the column where ``bad`` holds."""
    text = F.concat(F.lit(f"{message}: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(bad, F.raise_error(text).cast(kind)).otherwise(value)


def unsigned(value: Column, kind: str, name: str) -> Column:
    """uint64 domain (P14): null, negative, fractional, not finite or 2^64 and more raise; bool counts as 0/1.

    Integers up to int64 stay bigint; doubles and decimals become decimal(20,0), the type of a uint64 Parquet column.
    """
    if kind == "boolean":
        return guard(value.cast("int").cast("bigint"), value.isNull(), name, "bigint")
    if kind in INTEGER:
        return guard(value.cast("bigint"), value.isNull() | (value < 0), name, "bigint")
    if kind in {"double", "float"}:
        safe = F.when(value.isNull() | F.isnan(value) | (value < 0) | (value >= float(1 << 64)), F.lit(None).cast("double")).otherwise(value.cast("double"))
        high = F.floor(safe / float(1 << 32))
        low = safe - high.cast("double") * float(1 << 32)
        # in two halves: a cast of the whole double would go through its shortest decimal text
        exact = (high.cast("decimal(20,0)") * F.lit(1 << 32) + F.floor(low).cast("decimal(20,0)")).cast("decimal(20,0)")
        return F.when(safe.isNull() | (low != F.floor(low)), F.raise_error(F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("decimal(20,0)")).otherwise(exact)
    wide = value.cast("decimal(38,18)")
    bad = value.isNull() | (wide < 0) | (wide > F.lit(str(U64_MAX)).cast("decimal(20,0)")) | (wide != F.floor(wide))
    return F.when(bad, F.raise_error(F.lit(name)).cast("decimal(20,0)")).otherwise(value.cast("decimal(20,0)"))


def unscale(value: Column, kind: str, scale: int | None, name: str) -> Column:
    """integers divided by the file's scale; floats stay; an integer column without a positive scale is an error."""
    if kind in {"double", "float"}:
        return value.cast("double")
    if scale is None or scale <= 0:
        raise ValueError(f"{name}: integer column needs a positive scale, not {scale}")
    return value.cast("double") / F.lit(float(scale))


def derived_money(price: Column, volume: Column) -> Column:
    """price times volume as doubles; null if the price is."""
    return price.cast("double") * volume.cast("double")


def decode_type(code: Column, encoding: str, strict: bool = True) -> Column:
    """F8: codes through ``1=1,2=2,3=U``; an unknown code raises (null if not ``strict``), null stays null."""
    pairs = [p.split("=", 1) for p in encoding.split(",") if p]
    if not pairs:
        raise ValueError("empty type encoding")
    mapping = F.create_map(*[x for k, v in pairs for x in (F.lit(int(k)), F.lit(v))])
    found = F.try_element_at(mapping, code.cast("int"))
    if not strict:
        return found
    return F.when(code.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("unknown type code "), code.cast("string"))).cast("string")).otherwise(found)


def decode_text(value: Column, kind: str) -> Column:
    """bytes as UTF-8; trailing NULs are dropped."""
    text = F.decode(value, "UTF-8") if kind == "binary" else value
    return F.regexp_replace(text, "\\x00+$", "")


def raw_integer(value: Column, kind: str, scale: int, name: str = "value") -> Column:
    """the stored integer of a scaled value, without loss; a double must be finite, small enough and round-trip."""
    if not 1 <= scale <= MAX_SCALE:
        raise ValueError(f"{name}: scale must lie in 1..2^53")
    if kind in INTEGER:
        return value.cast("bigint")
    raw = F.rint(value * float(scale))
    bad = F.isnan(value) | (F.abs(value * float(scale)) > float(MAX_RAW)) | (raw / float(scale) != value)
    return F.when(value.isNull(), F.lit(None).cast("bigint")).when(bad, F.raise_error(F.concat(F.lit(f"{name} is no multiple of 1/{scale}: "), value.cast("string"))).cast("bigint")).otherwise(raw.cast("bigint"))


def check_amount(value: Column, name: str = "amount", allow_missing: bool = True) -> Column:
    """A number not negative and finite; null only if allowed (NaN is not a null)."""
    d = value.cast("double")
    bad = F.isnan(d) | (d < 0) | (d == float("inf"))
    if not allow_missing:
        bad = bad | value.isNull()
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"{name} is no amount: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("double")).otherwise(d)


def amount_ok(value: Column, allow_missing: bool = True) -> Column:
    """The check of :func:`check_amount` as a boolean."""
    d = value.cast("double")
    ok = ~F.isnan(d) & (d >= 0) & (d < float("inf"))
    return F.coalesce(ok, F.lit(allow_missing))


def pack(columns: Sequence[Column], bits: Sequence[int]) -> Column:
    """non-negative integers side by side in one 64-bit number, the first highest; more than 64 bits is an error, a value too wide raises.

    63 bits and fewer give a bigint that orders like the columns; 64 bits wrap into the sign.
    """
    if sum(bits) > 64:
        raise ValueError(f"{sum(bits)} bits do not fit 64")
    out = F.lit(0).cast("bigint")
    for c, b in zip(columns, bits, strict=True):
        wide = c.cast("bigint")
        bad = wide.isNull() | (wide < 0) | (F.shiftrightunsigned(wide, b) != 0 if b < 64 else F.lit(False))
        out = F.shiftleft(out, b).bitwiseOR(F.when(bad, F.raise_error(F.lit(f"value does not fit {b} bits")).cast("bigint")).otherwise(wide))
    return out


def cell_key(stock: Column, code: Column, n: int = 242) -> Column:
    """stock * 242 + minute, range-checked."""
    bad = stock.isNull() | code.isNull() | (stock < 0) | (code < 0) | (code >= n)
    return F.when(bad, F.raise_error(F.lit("cell key out of range")).cast("bigint")).otherwise(stock.cast("bigint") * n + code)


def order_identity(df: DataFrame, keys: Sequence[str], time: str = "time_ms") -> DataFrame:
    """Identity columns not null and not negative, time within the day; raises when a bad row is used."""
    missing = [c for c in [*keys, time] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    types = dict(df.dtypes)
    out = df
    for k in keys:
        bad = F.col(k).isNull() | (F.col(k) < 0) if types[k] in INTEGER else F.col(k).isNull()
        out = out.withColumn(k, guard(F.col(k), bad, f"bad {k}", types[k]))
    bad = F.col(time).isNull() | (F.col(time) < 0) | (F.col(time) >= 86_400_000)
    return out.withColumn(time, guard(F.col(time), bad, f"bad {time}", types[time]))


def digest(text: Column) -> Column:
    """SHA-256 of a text."""
    return F.sha2(text, 256)


def digest_of(*parts: str) -> str:
    """F14 on the driver: one digest of several parts, each with its length so that parts cannot run together."""
    h = hashlib.sha256()
    for p in parts:
        raw = p.encode()
        h.update(str(len(raw)).encode() + b":" + raw)
    return h.hexdigest()
