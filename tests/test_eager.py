import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import eager
from gridloom.operators.eager import PairAgg

AGGS = [PairAgg("n", "count"), PairAgg("sl", "sum_left", left="a"), PairAgg("sr", "sum_right", right="b"), PairAgg("sp", "sum_product", left="a", right="b"), PairAgg("lo", "min_left", left="a"), PairAgg("hi", "max_right", right="b")]
L, R = "k string, g string, a bigint, x int", "k string, b bigint, a string, g int"


def plain(left, right, how, by):
    le, ri = left.select(F.col("k").alias("k"), F.col("g").alias("g"), F.col("a").alias("la")), right.select(F.col("k").alias("k2"), F.col("b").alias("rb"))
    j = le.join(ri, F.col("k") == F.col("k2"), how).withColumn("k", F.coalesce("k", "k2"))
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("la").alias("sl"), F.sum("rb").alias("sr"), F.sum(F.col("la") * F.col("rb")).alias("sp"), F.min("la").alias("lo"), F.max("rb").alias("hi"))


def same(a, b):
    number = lambda t: tuple(None if v is None else v if isinstance(v, str) else int(v) for v in t)
    assert sorted(map(number, rows(a)), key=repr) == sorted(map(number, rows(b)), key=repr)


KEY = st.sampled_from(["a", "b", "c", None])
NUMBER = st.one_of(st.none(), st.integers(-5, 5))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(KEY, KEY, NUMBER), max_size=12), st.lists(st.tuples(KEY, NUMBER), max_size=12))
def test_equals_the_join(spark, le, ri):
    left = spark.createDataFrame([(k, g, a, 1) for k, g, a in le], L)
    right = spark.createDataFrame([(k, b, "z", 2) for k, b in ri], R)  # clashing names a and g
    same(eager.eager_join_aggregate(left, right, ["k"], ["k"], AGGS), plain(left, right, "inner", ["k"]))
    same(eager.eager_join_aggregate(left, right, ["k"], ["k"], AGGS, by_left=["g"]), plain(left, right, "inner", ["g"]))


@pytest.mark.parametrize("how", ["left", "full"])
def test_outer(spark, how):
    left = spark.createDataFrame([("a", "g", 1, 0), ("a", "g", 2, 0), ("b", "g", 5, 0)], L)
    right = spark.createDataFrame([("a", 10, "", 0), ("a", 20, "", 0), ("c", 7, "", 0)], R)
    same(eager.eager_join_aggregate(left, right, ["k"], ["k"], AGGS, how=how), plain(left, right, how, ["k"]))


def test_hot_key_makes_no_pairs(spark):
    n = 20_000
    left = spark.range(n).select(F.lit("hot").alias("k"), F.lit("g").alias("g"), F.col("id").alias("a"), F.lit(1).alias("x"))
    right = left.select("k", F.col("a").alias("b"), F.lit("").alias("a"), F.lit(1).alias("g"))
    got = eager.eager_join_aggregate(left, right, ["k"], ["k"], [PairAgg("n", "count"), PairAgg("sp", "sum_product", left="a", right="b")]).first()
    assert int(got.n) == n * n and int(got.sp) == (n * (n - 1) // 2) ** 2


def test_arguments():
    with pytest.raises(ValueError, match="how"):
        eager.eager_join_aggregate(None, None, ["a"], ["a"], [], how="cross")
    with pytest.raises(ValueError, match="same number"):
        eager.eager_join_aggregate(None, None, ["a"], [], [])


def test_key_shares(spark):
    schema = "trade_date string, symbol string, n_rows int"
    a = spark.createDataFrame([("d", "x", 0), ("d", "x", 0), ("d", None, 0), ("e", "y", 0)], schema)
    b = spark.createDataFrame([("d", "x", 0), ("d", None, 0)], schema)
    got = rows(eager.key_shares({"a": a, "b": b}, "trade_date", "symbol"))
    assert got == sorted([("a", "d", "x", 2, 3), ("a", "d", None, 1, 3), ("a", "e", "y", 1, 1), ("b", "d", "x", 1, 2), ("b", "d", None, 1, 2)], key=repr)
    assert rows(eager.key_shares({"a": a.limit(0), "b": b.limit(0)}, "trade_date", "symbol")) == []


def test_decimals_keep_their_scale(spark):
    from decimal import Decimal

    left = spark.sql("select * from values ('a', 0.40bd), ('a', 0.30bd), ('a', -12.35bd), ('b', cast(null as decimal(10,2))) t(k, x)").select("k", F.col("x").cast("decimal(10,2)").alias("x"))
    right = spark.sql("select * from values ('a', -0.00000001bd), ('a', 2.5bd), ('b', 1bd) t(k, y)").select("k", F.col("y").cast("decimal(20,8)").alias("y"))
    got = {r.k: r for r in eager.eager_join_aggregate(left, right, ["k"], ["k"], [PairAgg("sl", "sum_left", left="x"), PairAgg("sr", "sum_right", right="y"), PairAgg("sp", "sum_product", left="x", right="y"), PairAgg("lo", "min_left", left="x"), PairAgg("hi", "max_right", right="y")]).collect()}
    x, y = [Decimal("0.40"), Decimal("0.30"), Decimal("-12.35")], [Decimal("-0.00000001"), Decimal("2.5")]
    assert (got["a"].sl, got["a"].sr, got["a"].sp) == (2 * sum(x), 3 * sum(y), sum(x) * sum(y))
    assert (got["a"].lo, got["a"].hi) == (min(x), max(y)) and got["b"].sl is None and got["b"].sr == 1
    huge = spark.sql("select 'a' k, cast('99999999999999999999999999999999999.5' as decimal(38,1)) x")
    with pytest.raises(Exception, match="(?i)overflow|cannot be represented|out of range"):
        eager.eager_join_aggregate(huge, huge, ["k"], ["k"], [PairAgg("sp", "sum_product", left="x", right="x")]).collect()
    with pytest.raises(ValueError, match="38 digits"):
        wide = huge.select("k", F.col("x").cast("decimal(38,20)").alias("x"))
        eager.eager_join_aggregate(wide, wide, ["k"], ["k"], [PairAgg("sp", "sum_product", left="x", right="x")])
