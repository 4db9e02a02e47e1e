import datetime as dt
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridloom.functions import axis


def naive(t, pre=True, post=False):
    """Code by walking the clock, written independently of the engine's expression."""
    if t is None:
        return None
    if t < 0 or t >= 86_400_000:
        return -1
    seconds = t / 1000
    minute = -(-t // 60_000)  # the minute that ends at or after t
    if seconds <= 34_200:
        return 0 if pre or t == 34_200_000 else -1
    if seconds > 54_000:
        return 241 if post else -1
    if minute <= 689:
        return minute - 570
    if t <= 41_460_000:
        return 120
    if t < 46_740_000:
        return -1
    if minute <= 780:
        return 121
    return min(241, minute - 780 + 121)


def test_edges(spark):
    expected = {34_200_000: 0, 34_200_001: 1, 34_260_000: 1, 34_260_001: 2, 41_340_000: 119, 41_340_001: 120, 41_460_000: 120, 41_460_001: -1, 46_739_999: -1, 46_740_000: 121, 46_800_000: 121, 46_800_001: 122, 53_940_000: 240, 53_940_001: 241, 54_000_000: 241, 54_000_001: -1, 0: 0, 86_400_000: -1, -1: -1}
    df = spark.createDataFrame([(t,) for t in expected] + [(None,)], "t bigint").select("t", axis.minute_code_unchecked(F.col("t")).alias("c"))
    assert dict(rows(df)) == expected | {None: None}


@pytest.mark.parametrize(("pre", "post"), [(True, False), (True, True), (False, False), (False, True)])
def test_all_minute_edges_and_random(spark, pre, post):
    rnd = random.Random(5)
    times = sorted({m * 60_000 + d for m in range(1441) for d in (-1, 0, 1)} | {rnd.randrange(86_400_000) for _ in range(5000)})
    df = spark.createDataFrame([(t,) for t in times], "t bigint").select("t", axis.minute_code_unchecked(F.col("t"), pre, post).alias("c"))
    for t, c in rows(df):
        assert c == naive(t, pre, post), t


@pytest.mark.parametrize("bad", [None, -1, 86_400_000])
def test_checked_code_raises(spark, bad):
    df = spark.createDataFrame([(bad,)], "t bigint").select(axis.minute_code(F.col("t")).alias("c"))
    with pytest.raises(Exception, match="outside the day"):
        df.collect()


def test_labels_and_back(spark):
    df = spark.range(-1, 243).select(F.col("id").cast("int").alias("c"), axis.minute_label(F.col("id").cast("int"), F.lit("2025-01-02").cast("date")).alias("label"))
    df = df.withColumn("back", axis.code_of_label(F.col("label")))
    got = {c: (label, back) for c, label, back in (tuple(r) for r in df.collect())}
    assert got[-1][0] is None and got[242][0] is None
    assert [got[c][0].time() for c in (0, 120, 121, 241)] == [dt.time(9, 30), dt.time(11, 30), dt.time(13), dt.time(15)]
    assert all(got[c][1] == c for c in range(242))
    assert axis.axis(spark).count() == 242


def test_timestamps_floor_below_the_millisecond(spark):
    df = spark.sql("select timestamp_ntz'2025-01-02 09:30:00.000500' as a, timestamp_ntz'2025-01-02 09:30:00.001' as b")
    assert rows(df.select(axis.timestamp_minute_code(F.col("a")), axis.timestamp_minute_code(F.col("b")))) == [(0, 1)]
    zoned = spark.sql("select timestamp'2025-01-02 07:00:00' as z")  # session in UTC
    assert rows(zoned.select(axis.timestamp_minute_code(F.col("z"), zoned=True))) == [(241,)]
    gap = spark.sql("select interval '0 09:30:00.001' day to second as i")
    assert rows(gap.select(axis.time_ms_of(F.col("i"), "interval day to second"))) == [(34_200_001,)]


def test_position_is_folded(spark):
    df = spark.createDataFrame([(33_000_000, 0), (34_230_000, 1), (41_450_000, 120), (46_745_000, 121)], "t bigint, c int")
    assert [r[0] for r in df.select(axis.axis_position(F.col("t"), F.col("c"))).collect()] == [-59_999, -30_000, 0, -55_000]
