import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from gridloom.functions import aggs, normalize
from gridloom.operators import bridges, metric, verify, views
from gridloom.plans import catalogue

TICK = "trade_date date, symbol string, time_ms bigint, volume bigint, money bigint, side int, pos bigint"


def ticks(spark, data):
    return spark.createDataFrame([(None,) * 7] * 0 + data, TICK.replace("trade_date date", "trade_date string")).withColumn("trade_date", F.to_date("trade_date"))


def raises(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def one(spark, sql):
    return spark.sql(f"select {sql} as v")


@pytest.mark.parametrize(("sql", "kind", "expected"), [("4294967295L", "bigint", 4294967295), ("true", "boolean", 1), ("12.0D", "double", 12), ("cast('18446744073709551615' as decimal(20,0))", "decimal(20,0)", 2**64 - 1), ("cast(9223372036854775808 as double)", "double", 2**63)])
def test_unsigned(spark, sql, kind, expected):
    assert int(one(spark, sql).select(normalize.unsigned(F.col("v"), kind, "t.volume")).first()[0]) == expected


@pytest.mark.parametrize(("sql", "kind"), [("-1L", "bigint"), ("cast(null as bigint)", "bigint"), ("1.5D", "double"), ("double('NaN')", "double"), ("double('Infinity')", "double"), ("-1.0D", "double"), ("18446744073709551616D", "double"), ("cast('18446744073709551616' as decimal(21,0))", "decimal(21,0)"), ("cast(1.5 as decimal(10,2))", "decimal(10,2)")])
def test_not_unsigned(spark, sql, kind):
    raises(one(spark, sql).select(normalize.unsigned(F.col("v"), kind, "t.volume")), "t.volume")


def test_amounts_scales_types(spark):
    assert one(spark, "105000L").select(normalize.unscale(F.col("v"), "bigint", 10000, "price")).first()[0] == 10.5
    assert one(spark, "74L").select(normalize.unscale(F.col("v"), "bigint", 37, "price")).first()[0] == 2.0
    with pytest.raises(ValueError, match="scale"):
        normalize.unscale(F.col("v"), "bigint", None, "price")
    for bad in ("-1.0D", "double('Infinity')", "double('NaN')"):
        raises(one(spark, bad).select(normalize.check_amount(F.col("v"))), "no amount")
    missing = one(spark, "cast(null as double)")
    assert missing.select(normalize.check_amount(F.col("v"))).first()[0] is None
    raises(missing.select(normalize.check_amount(F.col("v"), allow_missing=False)), "no amount")
    assert one(spark, "3").select(normalize.decode_type(F.col("v"), "1=1,3=U")).first()[0] == "U"
    raises(one(spark, "4").select(normalize.decode_type(F.col("v"), "1=1,3=U")), "unknown type")
    assert one(spark, "12.34D").select(normalize.raw_integer(F.col("v"), "double", 10000)).first()[0] == 123400
    raises(one(spark, "0.00001D").select(normalize.raw_integer(F.col("v"), "double", 10000)), "no multiple")
    assert normalize.digest_of("a", "bc") != normalize.digest_of("ab", "c")


def test_pack_and_cells(spark):
    df = spark.createDataFrame([(1, 2), (1, 300)], "a int, b int")
    assert rows(spark.createDataFrame([(1, 2)], "a int, b int").select(normalize.pack([F.col("a"), F.col("b")], [8, 8]))) == [(258,)]
    raises(df.select(normalize.pack([F.col("a"), F.col("b")], [8, 8])), "does not fit")
    with pytest.raises(ValueError, match="64"):
        normalize.pack([F.col("a"), F.col("b")], [40, 40])
    raises(one(spark, "242").select(normalize.cell_key(F.lit(1), F.col("v"))), "out of range")


def test_sums(spark):
    big = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,), (1,)], "v bigint")
    assert int(big.agg(aggs.sum_u64(F.col("v"))).first()[0]) == 2**64 - 1
    raises(big.union(spark.createDataFrame([(1,)], "v bigint")).agg(aggs.sum_u64(F.col("v"))), "overflow")
    raises(spark.createDataFrame([(-1,)], "v bigint").agg(aggs.sum_u64(F.col("v"))), "negative")
    raises(spark.createDataFrame([(float("nan"),)], "v double").agg(aggs.sum_float(F.col("v"))), "finite")
    assert spark.createDataFrame([(None,)], "v double").agg(aggs.sum_float(F.col("v"))).first()[0] is None


def test_null_algebra(spark):
    """No event, unknown value, mixed, known zero - in one dense metric with empty value 0."""
    t = 34_200_001
    df = ticks(spark, [("2025-01-02", "a", t, 1, None, 49, 1), ("2025-01-02", "a", t + 60_000, 1, None, 49, 2), ("2025-01-02", "a", t + 60_000, 1, 5, 49, 3), ("2025-01-02", "a", t + 120_000, 1, 0, 49, 4), ("2025-01-02", "b", 42_000_000, 1, 9, 49, 5)])
    group = metric.MetricGroup((metric.MetricSpec("money_min", lambda: F.sum("money")), metric.MetricSpec("n_min", aggs.count_rows, empty_value=None)))
    dense = metric.compute({"chengjiao": df}, group)
    assert dense.count() == 2 * 242  # b has rows off the axis only
    got = {r.minute_code: (r.money_min, r.n_min) for r in dense.where("symbol = 'a'").collect()}
    assert got[1] == (None, 1) and got[2] == (5, 2) and got[3] == (0, 1) and got[4] == (0, None)
    assert {(r.money_min, r.n_min) for r in dense.where("symbol = 'b'").collect()} == {(0, None)}
    assert metric.repeated_cells(dense).count() == 0 and metric.unknown_cells(dense, metric.universe([df])).count() == 0
    assert verify.structure(metric.labelled(dense)).first().complete
    assert metric.compute({"chengjiao": df.limit(0)}, group).count() == 0


def test_null_times(spark):
    df = ticks(spark, [("2025-01-02", "a", None, 5, None, 49, 1), ("2025-01-02", "b", 34_200_001, 1, None, 49, 2)])
    volume = (metric.MetricSpec("v_min", lambda: F.sum("volume")),)
    for prepare in (None, lambda x: x["chengjiao"]):
        raises(metric.compute({"chengjiao": df}, metric.MetricGroup(volume, prepare)), "without time_ms")
        dense = metric.compute({"chengjiao": df}, metric.MetricGroup(volume, prepare, null_time="off_axis"))
        assert dense.count() == 2 * 242 and rows(dense.where("v_min > 0"), "symbol", "minute_code") == [("b", 1)]
    with pytest.raises(ValueError, match="null_time"):
        metric.MetricGroup(volume, null_time="drop")


def test_specs():
    for bad in ({"name": "Volume_min"}, {"name": "volume"}, {"name": "v_min", "value_type": "float32"}, {"name": "v_min", "empty_value": 0.5}, {"name": "v_min", "value_type": "uint64", "empty_value": -1}):
        with pytest.raises(ValueError):
            metric.MetricSpec(**{"aggregate": aggs.count_rows, **bad})
    one_metric = metric.MetricSpec("v_min", aggs.count_rows)
    with pytest.raises(ValueError, match="repeated"):
        metric.MetricGroup((one_metric, one_metric))
    with pytest.raises(ValueError, match="inputs"):
        metric.MetricGroup((one_metric, metric.MetricSpec("w_min", aggs.count_rows, inputs=("weituo",))))
    assert set(catalogue.GROUPS) and all(f().metrics for f in catalogue.GROUPS.values())


def test_fragments(spark):
    schema = "trade_date string, symbol string, channel int, side int, order_num bigint, time_ms bigint, volume bigint, money bigint"
    data = [("d", "a", 1, 49, 10, 34_261_000, 400, 4004), ("d", "a", 1, 49, 10, 34_200_001, 600, 6000), ("d", "a", 1, 49, 20, 34_200_005, 5, None), ("d", "a", 2, 49, 10, 34_200_001, 1, None), ("d", "a", 2, 49, 10, 34_200_001, 1, 7)]
    df = spark.createDataFrame(data, schema)
    whole = views.aggregate_order_fragments(df)
    assert rows(whole, "channel", "order_num", "time_ms", "volume", "money") == [(1, 10, 34_200_001, 1000, 10004), (1, 20, 34_200_005, 5, None), (2, 10, 34_200_001, 2, 7)]
    q = views.fragment_quality(whole).first()
    assert (q.input_fragments, q.orders, q.unknown_money_fragments, q.unknown_money_orders, q.unknown_money_volume, q.mixed_money_orders) == (5, 3, 2, 1, 5, 1)
    assert views.aggregate_order_fragments(df, use_channel=False).count() == 2
    raises(views.aggregate_order_fragments(df.withColumn("volume", F.lit(None).cast("bigint"))), "valid volume")


def test_participation(spark):
    schema = "trade_date string, symbol string, channel int, time_ms bigint, buy_order_num bigint, sell_order_num bigint, side int"
    data = [("d", "a", 1, 34_200_001, 1, 20, 49), ("d", "a", 1, 34_260_001, 1, 21, 49), ("d", "a", 1, 34_260_002, 1, 21, 49), ("d", "a", 1, 42_000_000, 0, 0, 49), ("d", "a", 1, 55_800_000, 9, 0, 49)]
    df = spark.createDataFrame(data, schema)
    count = lambda **k: views.trade_order_participation(df, **k).where("order_num <> 9").count()
    assert (count(side="buy"), count(side="sell"), count()) == (1, 2, 3)
    assert count(side="buy", scope="per_minute") == 2
    late = views.trade_order_participation(df, scope="per_minute").where("order_num = 9").first()
    assert late.minute_code == 241
    with pytest.raises(ValueError):
        views.trade_order_participation(df, side="none")
    with pytest.raises(ValueError):
        views.trade_order_participation(df, scope="none")


def test_path_entropy_centre(spark):
    t = 34_200_000
    data = [("2025-01-02", "a", t + 1000, 2, 10, 49, 1), ("2025-01-02", "a", t + 1000, 3, None, 50, 2), ("2025-01-02", "a", t + 31_000, 5, 4, 50, 3), ("2025-01-02", "b", t + 60_000, 0, None, 49, 4)]
    df = ticks(spark, data).withColumn("minute_code", F.lit(1))
    cell = ["trade_date", "symbol", "minute_code"]
    p = {r.symbol: r for r in aggs.path_extremes(df, cell, ["time_ms", "pos"], "side", {"v": F.col("volume"), "m": F.col("money")}).collect()}
    assert (p["a"].v_buy, p["a"].v_sell, p["a"].v_abs) == (2, 6, 8) and (p["a"].m_buy, p["a"].m_sell) == (10, 0)
    assert p["b"].m_buy is None and p["b"].v_abs == 0
    e = {r.symbol: r for r in df.groupBy(*cell).agg(aggs.entropy(F.col("volume")).alias("h"), aggs.time_centre(F.col("time_ms")).alias("c"), aggs.time_centre(F.col("time_ms"), F.col("volume"), F.col("side"), 50).alias("s"), aggs.side_sum(F.col("volume"), F.col("side")).alias("b")).collect()}
    share = np.array([0.2, 0.3, 0.5])
    assert e["a"].h == pytest.approx(-(share * np.log(share)).sum()) and e["b"].h is None
    assert e["a"].c == 11.0 and e["a"].s == pytest.approx((3 * 1 + 5 * 31) / 8) and e["b"].c == 0.0 and e["b"].s is None
    assert (e["a"].b, e["b"].b) == (2, 0)


def test_scatter_and_group_rows(spark):
    df = spark.createDataFrame([(2, 5), (0, None)], "k bigint, v bigint")
    assert [r[0] for r in metric.scatter(df, 4, "k", "v", -1).orderBy("k").select("v").collect()] == [None, -1, 5, -1]
    raises(metric.scatter(df.union(spark.createDataFrame([(4, 1)], "k bigint, v bigint")), 4, "k", "v", -1), "out of range")
    g = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, v int")
    assert rows(metric.group_to_rows(g, ["k"], {"total": F.sum("v")})) == sorted([("a", 1, 3), ("a", 2, 3), (None, 5, 5)], key=repr)


def test_blocks(spark):
    df = ticks(spark, [("2025-01-02", "a", 1, v, None, 49, v) for v in (3, 4, 5)]).withColumn("minute_code", F.col("volume").cast("int") % 2)
    good = lambda b: {"v": (np.unique(b["minute_code"]), np.array([b["volume"][b["minute_code"] == c].sum() for c in np.unique(b["minute_code"])]))}
    assert rows(bridges.compute_blocks(df, ["volume"], good, {"v": "bigint"}), "symbol", "minute_code", "v") == [("a", 0, 4), ("a", 1, 8)]
    for bad in (lambda b: {}, lambda b: {"v": (np.array([1, 1]), np.array([1, 1]))}, lambda b: {"v": (np.array([242]), np.array([1]))}, lambda b: {"v": (np.array([0.5]), np.array([1]))}):
        raises(bridges.compute_blocks(df, ["volume"], bad, {"v": "bigint"}), "block returned|bad cell keys")
    assert rows(bridges.reduce_cells(df, lambda pdf: int(pdf["volume"].max()), "m", "bigint"), "minute_code", "m") == [(0, 4), (1, 5)]


def test_compare(spark):
    schema = "trade_date string, minute string, symbol string, v double"
    a = spark.createDataFrame([("d", "1", "x", 1.0), ("d", "2", "x", None), ("d", "3", "x", 2.0), ("d", "4", "x", 1.0), ("d", "6", "x", 1.0), ("d", "7", "x", 1.0)], schema)
    b = spark.createDataFrame([("d", "1", "x", 1.0 + 1e-12), ("d", "2", "x", 0.0), ("d", "3", "x", 3.0), ("d", "5", "x", 1.0), ("d", "6", "x", float("inf")), ("d", "7", "x", 1.0), ("d", "7", "x", 1.0)], schema)
    found = {r.minute: r.problem for r in verify.compare(a, b, "v", rtol=1e-10).collect()}
    assert found == {"2": "null", "3": "differs", "4": "missing", "5": "extra", "6": "non_finite", "7": "repeated"}
    i = a.select("trade_date", "minute", "symbol", F.col("v").cast("bigint").alias("v"))
    assert verify.compare(i, i.withColumn("v", F.col("v") + 1), "v", rtol=10.0).where("problem = 'differs'").count() == 5  # integers are exact
    with pytest.raises(ValueError, match="nothing"):
        verify.validate_published({}, {}, verify.DayReference(lambda x: x, "id"))
    assert verify.schema_problems(a, [("trade_date", "string", True), ("minute", "string", True), ("symbol", "string", False), ("v", "float", True)]) == ["symbol may be null", "v: double, expected float"]


def test_grid_faults(spark):
    dense = spark.range(242).select(F.to_date(F.lit("2025-01-02")).alias("trade_date"), F.lit("a").alias("symbol"), F.col("id").cast("int").alias("minute_code"), F.lit(1).alias("v"))
    good = metric.labelled(dense)
    assert verify.grid_problems(good).count() == 0 and verify.structure(good).first().complete
    swapped = metric.labelled(dense.withColumn("minute_code", F.when(F.col("minute_code") == 7, 8).otherwise(F.col("minute_code"))))
    assert not verify.structure(swapped).first().complete  # the row count alone is right
    assert verify.grid_problems(swapped).first().n_codes == 241
    placed = good.withColumn("p", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("minute")))
    assert verify.unordered_rows(placed, "p").count() == 0
    assert verify.unordered_rows(placed.withColumn("p", -F.col("p")), "p").first().n_unordered == 241
    assert verify.preflight(good, ["a", "b"], "2025-01-02").first()[:] == (242, 1, 0, 0)


def test_densify_edges(spark):
    days = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b"), ("e", "a")], "trade_date string, symbol string")
    cells = spark.createDataFrame([("d", "a", 0, 5), ("d", "a", 3, None), ("d", "b", 9, 1), ("d", "b", 9, 2), ("d", "c", 1, 1), ("e", "a", 10, 1), ("e", "a", -1, 1)], "trade_date string, symbol string, minute_code int, v int")
    got = rows(metric.densify(cells, days, {"v": 0}, n_labels=10))
    want = [("d", "a", c, {0: 5, 3: None}.get(c, 0)) for c in range(10)] + [("d", "b", c, 0) for c in range(9)] + [("d", "b", 9, 1), ("d", "b", 9, 2)] + [("e", "a", c, 0) for c in range(10)]
    assert got == sorted(want, key=repr)
    assert rows(metric.repeated_cells(cells), "symbol", "minute_code", "n") == [("b", 9, 2)]
    assert ("d", "c", 1) in rows(metric.unknown_cells(cells, days, 10)) and ("e", "a", 10) in rows(metric.unknown_cells(cells, days, 10))
    plan = metric.densify(cells, days.distinct(), {"v": 0})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_preflight_of_every_day_and_table(spark):
    make = lambda data: spark.createDataFrame(data, "trade_date string, symbol string")
    got = verify.preflight_days({"x": make([("d", "a"), ("d", "a"), ("d", "b"), ("e", "a"), (None, "a")]), "y": make([("d", "a"), ("d", None)]), "z": make([("d", "a"), ("d", "c"), ("e", "a"), ("e", "b")])})
    assert rows(got.where("trade_date is not null"), "table_name", "trade_date", "n_rows", "n_null_symbols", "n_missing_symbols", "n_extra_symbols", "n_wrong_dates") == [
        ("x", "d", 3, 0, 1, 1, 0), ("x", "e", 1, 0, 1, 0, 0), ("y", "d", 2, 1, 2, 0, 0), ("y", "e", 0, 0, 2, 0, 0), ("z", "d", 2, 0, 1, 1, 0), ("z", "e", 2, 0, 0, 1, 0),
    ]
    assert rows(got.where("trade_date is null"), "table_name", "n_rows", "n_wrong_dates") == [("x", 1, 1), ("y", 0, 0), ("z", 0, 0)]
    with pytest.raises(ValueError, match="no others"):
        verify.preflight_days({"x": make([("d", "a")])})


def test_preflight_of_footers(spark, tmp_path):
    import datetime as dt

    import pyarrow as pa
    import pyarrow.parquet as pq

    def write(name, keys, symbol, date):
        pq.write_table(pa.table({"symbol": symbol, "date": date}).replace_schema_metadata(keys), tmp_path / name)
        return str(tmp_path / name)

    day, good = pa.array([dt.date(2025, 1, 2)]), {"price_policy_version": "3", "format_version": "1"}
    files = [write("a", good, pa.array(["s"]), day), write("b", good | {"price_policy_version": "2"}, pa.array(["s"]), day), write("c", {"format_version": "1"}, pa.array([b"s"]), pa.array([20250102]))]
    assert rows(verify.footer_faults(spark, files[:1])) == []
    assert rows(verify.footer_faults(spark, files), "field", "found", "n_files") == [("date", "int64", 1), ("price_policy_version", "2", 1), ("price_policy_version", None, 1), ("symbol", "binary", 1)]
