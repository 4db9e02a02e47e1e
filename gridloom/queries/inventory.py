"""Queries of the inventory's operators, keyed ``q_<id>_<name>``, over the tick tables and the events mapped to ticks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import aggs, axis, normalize
from gridloom.operators import bridges, metric, verify, views
from gridloom.plans import catalogue
from gridloom.session import table

CELL = ["trade_date", "symbol", "minute_code"]


def day(name: str = "trade_date"):  # noqa: ANN201
    return F.date_format(F.col(name), "yyyy-MM-dd").alias(name)


def moment(name: str):  # noqa: ANN201
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events as trades: symbol = event type, position = event id, unknown money where k is a multiple of five."""
    k = F.get_json_object("props", "$.k").cast("long")
    volume = F.round(F.col("value") * 100).cast("long")
    return table(spark, d, "events").select(
        F.to_date("ts").alias("trade_date"), F.col("event_type").alias("symbol"), axis.time_ms_of(F.col("ts"), "timestamp_ntz").alias("time_ms"), F.col("event_id").alias("pos"), (F.col("user_id") % 4).alias("channel"),
        (F.lit(49) + F.col("event_id") % 2).cast("int").alias("side"), F.col("user_id").alias("order_num"), F.col("user_id").alias("buy_order_num"), k.alias("sell_order_num"), volume.alias("volume"), F.when(k % 5 != 0, volume * k).alias("money"), F.col("ts"), F.col("user_id"),
    )


def trades(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chengjiao")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "weituo")


def out(df: DataFrame, *extra: str) -> DataFrame:
    """Cells with the date as text."""
    rest = [c for c in df.columns if c not in CELL]
    return df.select(day(), "symbol", "minute_code", *rest, *extra)


def coded(df: DataFrame, pre: bool = True, post: bool = False) -> DataFrame:
    return df.withColumn("minute_code", axis.minute_code_unchecked(F.col("time_ms"), pre, post)).where("minute_code >= 0")


# --- axis and scalar functions


def q_F1_minute_codes(spark: SparkSession, d: str) -> DataFrame:
    """All four flag combinations over every time of trades."""
    t = F.col("time_ms")
    return trades(spark, d).select("time_ms").distinct().select("time_ms", *[axis.minute_code_unchecked(t, pre, post).alias(f"code_{int(pre)}{int(post)}") for pre in (True, False) for post in (True, False)])


def q_F3_timestamp_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", axis.timestamp_minute_code(F.col("ts")).alias("code"))


def q_F4_labels(spark: SparkSession, d: str) -> DataFrame:
    dates = trades(spark, d).select("trade_date").distinct()
    return dates.select("trade_date", F.explode(F.sequence(F.lit(0), F.lit(241))).alias("code")).select(day(), "code", F.date_format(axis.minute_label(F.col("code"), F.col("trade_date")), "yyyy-MM-dd HH:mm:ss").alias("label"))


def q_F5_milliseconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", axis.time_ms_of(F.col("ts"), "timestamp_ntz").alias("time_ms"))


def q_F6_scales(spark: SparkSession, d: str) -> DataFrame:
    """Scaled integers as doubles, and derived money of orders."""
    price = normalize.unscale(F.col("price"), "bigint", 10000, "price")
    return orders(spark, d).select(day(), "channel", "order_num", moment("recv_time"), price.alias("price"), normalize.unscale(F.col("money"), "bigint", 10000, "money").alias("money"), normalize.derived_money(price, F.col("volume")).alias("derived_money"))


def q_F8_types(spark: SparkSession, d: str) -> DataFrame:
    """The table holds codes that its encoding does not: they come out as null."""
    return orders(spark, d).select(normalize.decode_type(F.col("type"), "1=1,2=2,3=U,50=50,85=85", strict=False).alias("type_text")).groupBy("type_text").agg(F.count(F.lit(1)).alias("n"))


def q_F9_raw_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices made double and brought back to the stored integers, summed exactly per symbol."""
    price = normalize.raw_integer(F.col("price").cast("double") / 10000, "double", 10000, "price")
    return trades(spark, d).groupBy("symbol").agg(F.sum(price).alias("raw_sum"))


def q_F10_packed_keys(spark: SparkSession, d: str) -> DataFrame:
    key = normalize.pack([F.col("channel"), F.col("order_num"), F.col("side")], [16, 32, 8])
    return orders(spark, d).groupBy(day(), key.alias("packed")).agg(F.count(F.lit(1)).alias("n"))


def q_F11_cell_keys(spark: SparkSession, d: str) -> DataFrame:
    stocks = trades(spark, d).select("symbol").distinct().select("symbol", F.regexp_extract("symbol", r"^(\d+)", 1).cast("long").alias("stock"))
    return coded(trades(spark, d)).join(stocks, "symbol").groupBy(normalize.cell_key(F.col("stock"), F.col("minute_code")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def q_F12_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.encode(F.concat(F.col("symbol"), F.lit("\x00\x00")), "UTF-8")
    return trades(spark, d).select(normalize.decode_text(raw, "binary").alias("symbol")).distinct()


def q_F14_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "day_file").select("file_id", normalize.digest(F.concat_ws("|", F.col("file_id").cast("string"), "content_digest")).alias("digest"))


# --- projections and filters


def q_P2_on_axis(spark: SparkSession, d: str) -> DataFrame:
    return coded(trades(spark, d)).groupBy(day(), "minute_code").agg(F.count(F.lit(1)).alias("n"))


def q_P3_market_switches(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("time_ms")
    flags = [F.count(F.when(axis.minute_code_unchecked(t, pre, post) >= 0, 1)).alias(f"n_{int(pre)}{int(post)}") for pre in (True, False) for post in (True, False)]
    return trades(spark, d).groupBy(day()).agg(*flags)


def q_P4_order_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Legs of trades with an order number, by the operator that drops those without."""
    return views.legs(trades(spark, d)).groupBy(day(), F.col("channel").cast("int").alias("channel"), "order_side").agg(F.count(F.lit(1)).alias("n"))


def q_P6_sides(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("volume")
    return orders(spark, d).groupBy(day(), "symbol").agg(F.sum(F.when(F.col("side") == 49, v)).alias("buy_volume"), F.sum(F.when(F.col("side") == 50, v)).alias("sell_volume"))


def q_P7_session(spark: SparkSession, d: str) -> DataFrame:
    """[09:30, 11:30) and [13:00, 14:57)."""
    t = F.col("time_ms")
    inside = ((t >= axis.OPEN_MS) & (t < axis.NOON_MS)) | ((t >= axis.REOPEN_MS) & (t < axis.CLOSE_MS - 180_000))
    return trades(spark, d).where(inside).groupBy(day(), "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


def q_P8_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the amount check would refuse, per column."""
    ok = lambda c, missing: F.count(F.when(~normalize.amount_ok(F.col(c), missing), 1))
    return orders(spark, d).groupBy(day()).agg(ok("money", True).alias("bad_money"), ok("price", True).alias("bad_price"), ok("money", False).alias("bad_or_missing_money"))


# --- aggregations and dense metrics


def q_J1_dense_minute(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: events per type and day over all 242 labels - volume, count (empty 0), distinct users (empty null)."""
    group = metric.MetricGroup(
        (
            metric.MetricSpec("volume_min", lambda: aggs.sum_int(F.col("volume"))),
            metric.MetricSpec("count_min", aggs.count_rows),
            metric.MetricSpec("users_min", lambda: aggs.distinct_count(F.col("user_id")), empty_value=None),
        )
    )
    return out(metric.compute({"chengjiao": ticks(spark, d)}, group))


def _dense(spark: SparkSession, d: str, name: str) -> DataFrame:
    # the test tables hold trades without time
    group = replace(catalogue.GROUPS[name](), null_time="off_axis")
    return metric.compute({n: table(spark, d, n) for n in group.metrics[0].inputs}, group)


def q_D11_trades_basic(spark: SparkSession, d: str) -> DataFrame:
    return out(_dense(spark, d, "trades_basic"))


def q_A12_orders_basic(spark: SparkSession, d: str) -> DataFrame:
    """Known money: 0 for an empty cell, null where no money is known."""
    df = out(_dense(spark, d, "orders_basic"))
    return df.withColumn("known_money_min", F.round("known_money_min", 4))


def q_A3_volume_u64(spark: SparkSession, d: str) -> DataFrame:
    return coded(trades(spark, d)).groupBy(*CELL).agg(aggs.sum_u64(F.col("volume")).cast("bigint").alias("volume")).select(day(), "symbol", "minute_code", "volume")


def q_A4_sum_float(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).groupBy("symbol").agg(F.round(aggs.sum_float(F.col("money").cast("double") / 10000), 2).alias("money"))


def q_A6_ohlc(spark: SparkSession, d: str) -> DataFrame:
    return out(_dense(spark, d, "prices").where("open_price_min is not null"))


def q_A6_ohlc_grid(spark: SparkSession, d: str) -> DataFrame:
    """All 242 labels, those without priced trades included."""
    return out(_dense(spark, d, "prices"))


def q_A8_first_last(spark: SparkSession, d: str) -> DataFrame:
    """First and last volume of a cell in source order (position = event id)."""
    order = ("time_ms", "pos")
    return out(coded(ticks(spark, d)).groupBy(*CELL).agg(aggs.first_value(F.col("volume"), order).alias("first_volume"), aggs.last_value(F.col("volume"), order).alias("last_volume"), F.min("volume").alias("min_volume"), F.max("volume").alias("max_volume")))


def q_A10_distinct_orders(spark: SparkSession, d: str) -> DataFrame:
    return out(coded(trades(spark, d)).groupBy(*CELL).agg(aggs.distinct_count(F.col("buy_order_num")).alias("buyers"), aggs.distinct_count(F.col("sell_order_num")).alias("sellers")))


def q_A11_group_take(spark: SparkSession, d: str) -> DataFrame:
    """Grouping on an unsorted key with sum, count and the first row in source order."""
    return ticks(spark, d).groupBy("channel", "side").agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"), F.min_by("order_num", "pos").alias("first_order"))


def q_A13_cell_reducer(spark: SparkSession, d: str) -> DataFrame:
    """A Python reducer per cell: the range of volumes."""
    cells = coded(ticks(spark, d)).select(*CELL, "volume")
    return out(bridges.reduce_cells(cells, lambda pdf: int(pdf["volume"].max() - pdf["volume"].min()), "volume_range", "bigint"))


def q_A14_universe(spark: SparkSession, d: str) -> DataFrame:
    return metric.universe([table(spark, d, n) for n in ("weituo", "chengjiao", "chedan")]).select(day(), "symbol")


def q_J3_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Trades per label over 0..241 with a fill of -1."""
    counts = coded(trades(spark, d)).groupBy(F.col("minute_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return metric.scatter(counts, 242, "code", "n", -1)


def q_J4_share_of_group(spark: SparkSession, d: str) -> DataFrame:
    """Each order's volume beside its symbol's total and largest order of the day."""
    rows = metric.group_to_rows(orders(spark, d), ["trade_date", "symbol"], {"total": F.sum("volume"), "largest": F.max("volume")})
    return rows.select(day(), "symbol", F.col("channel").cast("int").alias("channel"), "order_num", moment("recv_time"), "volume", "total", "largest")


# --- windows


def q_W1_path_extremes(spark: SparkSession, d: str) -> DataFrame:
    cells = coded(ticks(spark, d))
    weights = {"d": F.lit(1), "v": F.col("volume"), "m": F.col("money")}
    return out(aggs.path_extremes(cells, CELL, ["time_ms", "pos"], "side", weights))


def q_W2_shape_grid(spark: SparkSession, d: str) -> DataFrame:
    """Shape of all 242 labels, those without trades included."""
    df = out(_dense(spark, d, "shape"))
    for c in ("volume_entropy_min", "time_centre_min", "volume_centre_min"):
        df = df.withColumn(c, F.floor(F.col(c) * 1e6 + 0.5).cast("double") / 1e6)
    return df


def q_W2_shape(spark: SparkSession, d: str) -> DataFrame:
    """Entropy, time centres and buy-side volume (W2-W4) of trades."""
    df = out(_dense(spark, d, "shape").where("time_centre_min is not null"))
    # rounded by floor, which both engines do alike at ties
    for c in ("volume_entropy_min", "time_centre_min", "volume_centre_min"):
        df = df.withColumn(c, F.floor(F.col(c) * 1e6 + 0.5).cast("double") / 1e6)
    return df


# --- order views


def q_V1_fragments(spark: SparkSession, d: str) -> DataFrame:
    orders_whole = views.aggregate_order_fragments(orders(spark, d).withColumn("volume", F.coalesce("volume", F.lit(0))))
    return orders_whole.select(day(), "symbol", F.col("channel").cast("int").alias("channel"), F.col("side").cast("int").alias("side"), "order_num", "time_ms", "volume", F.col("money").cast("string").alias("money"), "n_fragments")


def q_V2_quality(spark: SparkSession, d: str) -> DataFrame:
    whole = views.aggregate_order_fragments(orders(spark, d).withColumn("volume", F.coalesce("volume", F.lit(0))))
    return views.fragment_quality(whole).withColumn("trade_date", day())


def q_V3_participation(spark: SparkSession, d: str) -> DataFrame:
    df = views.trade_order_participation(trades(spark, d))
    return df.select(day(), "symbol", F.col("channel").cast("int").alias("channel"), "order_side", "order_num", "time_ms")


def q_V4_participation_minute(spark: SparkSession, d: str) -> DataFrame:
    return out(_dense(spark, d, "participation").where("participating_order_count_min is not null"))


def q_V4_participation_grid(spark: SparkSession, d: str) -> DataFrame:
    """All 242 labels, those without participating orders included."""
    return out(_dense(spark, d, "participation"))


def q_V5_whole_orders(spark: SparkSession, d: str) -> DataFrame:
    """Dense metrics over whole orders."""
    return out(_dense(spark, d, "whole_orders"))


# --- set operations, sorts


def q_U1_orders_and_trades(spark: SparkSession, d: str) -> DataFrame:
    return out(_dense(spark, d, "orders_and_trades"))


def q_U2_legs(spark: SparkSession, d: str) -> DataFrame:
    return views.legs(trades(spark, d)).groupBy(day(), "order_side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("channel", "order_num").alias("orders"))


def q_U3_all_dates(spark: SparkSession, d: str) -> DataFrame:
    names = ("weituo", "chengjiao", "chedan", "minute_volume")
    parts = None
    for n in names:
        p = table(spark, d, n).select("trade_date").distinct()
        parts = p if parts is None else parts.union(p)
    return parts.distinct().select(day())


def q_U4_missing_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days of trades that are not published (R3: what a resumed run would compute)."""
    published = table(spark, d, "minute_volume").select("trade_date").distinct()
    return trades(spark, d).select("trade_date").distinct().join(published, "trade_date", "left_anti").select(day())


def q_U5_common_symbols(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = (table(spark, d, n).select("trade_date", "symbol").distinct() for n in ("weituo", "chengjiao", "chedan"))
    return a.intersect(b).intersect(c).select(day(), "symbol")


def q_O4_order_view(spark: SparkSession, d: str) -> DataFrame:
    """Position of every whole order within its channel and day, by earliest time and number."""
    from pyspark.sql import Window

    whole = views.aggregate_order_fragments(orders(spark, d), volume=None, money=None)
    w = Window.partitionBy("trade_date", "channel").orderBy("time_ms", "order_num", "symbol", "side")
    return whole.select(day(), "symbol", F.col("channel").cast("int").alias("channel"), "order_num", F.col("side").cast("int").alias("side"), "time_ms", F.row_number().over(w).alias("place"))


def q_O5_representative_days(spark: SparkSession, d: str) -> DataFrame:
    """The day with most trades, the first and the last."""
    from gridloom.plans.runner import representative_days

    return representative_days(trades(spark, d).groupBy(F.col("trade_date").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))).select(day("day").alias("trade_date"))


# --- sources and verification


def q_S7_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of all tick tables from the footers of their files, read on the executors; no data page is touched."""
    from gridloom.sources import footer

    parts = None
    for n in ("weituo", "chengjiao", "chedan", "minute_volume"):
        p = footer.row_counts(spark, table(spark, d, n).inputFiles()).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        parts = p if parts is None else parts.union(p)
    return parts


def q_S8_published_dates(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.sources.published import dates_of

    return dates_of(table(spark, d, "minute_volume")).select(day())


def _expected_volume(spark: SparkSession, d: str) -> DataFrame:
    cells = coded(trades(spark, d)).groupBy(*CELL).agg(F.sum("volume").alias("trade_volume_min"))
    days = table(spark, d, "minute_volume").select("trade_date").distinct()
    return metric.labelled(cells).join(days, "trade_date", "left_semi")


def q_C3_published_differences(spark: SparkSession, d: str) -> DataFrame:
    """Published volume against volume computed again from trades, cell by cell."""
    published = table(spark, d, "minute_volume").select("trade_date", "minute", "symbol", "trade_volume_min")
    found = verify.compare(_expected_volume(spark, d), published, "trade_volume_min")
    return found.select(day(), F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "symbol", "expected", "actual", "problem")


def q_C2_structure(spark: SparkSession, d: str) -> DataFrame:
    found = verify.structure(table(spark, d, "minute_volume"))
    return found.withColumn("trade_date", day())


def q_C2_structure_dense(spark: SparkSession, d: str) -> DataFrame:
    """Structure of the engine's own dense result: always complete."""
    dense = metric.labelled(_dense(spark, d, "trades_basic").select(*CELL, "trade_volume_min"))
    return verify.structure(dense).withColumn("trade_date", day())


def q_C5_grid(spark: SparkSession, d: str) -> DataFrame:
    found = verify.grid_problems(table(spark, d, "minute_volume"))
    return found.withColumn("trade_date", day())


def q_P11_repeated_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "minute_volume").withColumn("minute_code", axis.code_of_label(F.col("minute")))
    return out(metric.repeated_cells(cells))


def q_P12_unknown_cells(spark: SparkSession, d: str) -> DataFrame:
    """Published cells of symbols that have no order that day, or off the axis."""
    cells = table(spark, d, "minute_volume").withColumn("minute_code", axis.code_of_label(F.col("minute")))
    return out(metric.unknown_cells(cells, metric.universe([orders(spark, d)])))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    def block(b: dict) -> dict:
        codes, starts = np.unique(b["minute_code"], return_index=True)
        ends = np.append(starts[1:], len(b["minute_code"]))
        return {"n": (codes, (ends - starts).astype(np.int64)), "volume": (codes, np.add.reduceat(b["volume"].astype(np.int64), starts) if len(codes) else np.zeros(0, np.int64))}

    return bridges.compute_blocks(coded(trades(spark, d)), ["volume"], block, {"n": "bigint", "volume": "bigint"})


def q_X5_blocks(spark: SparkSession, d: str) -> DataFrame:
    """numpy blocks per symbol-day: count and volume by segment sums."""
    return out(_blocks(spark, d))


def q_J2_block_grid(spark: SparkSession, d: str) -> DataFrame:
    """Results of numpy blocks as full grids: every symbol-day of the unfiltered trades has all 242 labels."""
    return out(metric.densify(_blocks(spark, d), metric.universe([trades(spark, d)]), {"n": 0, "volume": 0}))


def q_L1_lineitem_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Volume driver: line items at synthetic times, as symbols by flag and status."""
    t = (F.col("l_orderkey") * 7919 + F.col("l_linenumber").cast("long") * 104729) % 86_400_000
    rows = table(spark, d, "lineitem").select(F.lit("2024-01-02").cast("date").alias("trade_date"), F.concat("l_returnflag", "l_linestatus").alias("symbol"), t.alias("time_ms"), F.col("l_quantity").cast("long").alias("volume"), "l_orderkey")
    group = metric.MetricGroup((metric.MetricSpec("quantity_min", lambda: aggs.sum_int(F.col("volume"))), metric.MetricSpec("orders_min", lambda: aggs.distinct_count(F.col("l_orderkey")))))
    return out(metric.compute({"chengjiao": rows}, group))


def q_T1_stream_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Minute sums of trades by an available-now stream over the table's files."""
    import uuid

    from gridloom.session import checkpoint_dir
    from gridloom.streaming import daily

    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = trades(spark, d).schema
    source = f"{d}/chengjiao.parquet"
    from pathlib import Path

    # a stream reads folders: a table that is one file is named by a pattern
    path = source if not Path(source).is_file() else f"{d}/chengjiao*.parquet"
    daily.append_days(daily.tick_stream(spark, path, schema), f"{folder}/out", f"{folder}/state")
    return out(daily.read_sums(spark, f"{folder}/out"))


# --- further inventory entries


def q_S2_logical_cancels(spark: SparkSession, d: str) -> DataFrame:
    """Day-file scan with footer metadata: scales decoded, unsigned checks, derived money."""
    from gridloom.sources import dayfiles

    files = table(spark, d, "chedan").inputFiles()
    df = dayfiles.read_files(spark, files, "chedan", ["symbol", "trade_date", "time_ms", "order_num", "price", "volume", "money"])
    return df.select(day(), "symbol", "time_ms", "order_num", "price", "volume", F.round("money", 4).alias("money"))


def q_S4_field_info(spark: SparkSession, d: str) -> DataFrame:
    """Physical types and scales over the footers of all files of the three tick tables."""
    from gridloom.sources import dayfiles

    logical = ["symbol", "trade_date", "time_ms", "price", "volume", "money"]
    found = [dayfiles.field_infos(spark, table(spark, d, n).inputFiles(), logical, n).select(F.lit(n).alias("table_name"), "*") for n in TICKS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def q_S6_date_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Days that a table lacks while another one has them."""
    from gridloom.sources.paths import missing_days

    tables = {n: table(spark, d, n).select(F.col("trade_date").alias("day")) for n in ("weituo", "chengjiao", "chedan", "minute_volume")}
    return missing_days(tables).select(F.col("name").alias("table_name"), day("day").alias("trade_date"))


def q_S10_publish(spark: SparkSession, d: str) -> DataFrame:
    """A metric published as day partitions and read back."""
    import uuid

    from gridloom.session import checkpoint_dir
    from gridloom.sources import published

    root = f"{checkpoint_dir(spark).removeprefix('file://')}/publish-{uuid.uuid4().hex}"
    dense = metric.labelled(_dense(spark, d, "trades_basic").select(*CELL, "trade_volume_min"))
    published.write_days(dense, root, "trade_volume_min", published.RunConfig(d, root))
    back = published.read_metric(spark, root, "trade_volume_min")
    return back.select(day(), F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "symbol", "trade_volume_min")


def q_P5_known_values(spark: SparkSession, d: str) -> DataFrame:
    """Unpriced orders count in the number and the volume, not in the money."""
    known = F.col("price").isNotNull()
    return orders(spark, d).groupBy(day(), "symbol").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(known, 1)).alias("n_priced"), F.sum(F.when(known, F.col("money"))).alias("priced_money"))


def q_P9_order_identity(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose identity is complete and whose time lies in the day; the checked columns are used, so a bad row would raise."""
    good = orders(spark, d).where("time_ms < 86400000")
    return normalize.order_identity(good, ["symbol", "channel", "side", "order_num"]).groupBy("symbol").agg(F.count_distinct("channel", "side", "order_num").alias("orders"), F.min("time_ms").alias("first_ms"))


def q_P14_unsigned(spark: SparkSession, d: str) -> DataFrame:
    volume = normalize.unsigned(F.col("volume").cast("double"), "double", "chengjiao.volume")
    return trades(spark, d).groupBy("symbol").agg(F.sum(volume).cast("bigint").alias("volume"))


def q_A15_quality(spark: SparkSession, d: str) -> DataFrame:
    """Global block statistics with conditional counts."""
    return trades(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("price").isNull(), 1)).alias("unpriced"), F.count(F.when(F.col("time_ms").isNull(), 1)).alias("untimed"), F.sum(F.when(F.col("money").isNull(), F.col("volume"))).alias("unknown_money_volume"))


def q_W5_source_order(spark: SparkSession, d: str) -> DataFrame:
    """Running volume within a cell in source order, ties of time by position."""
    from pyspark.sql import Window

    w = Window.partitionBy(*CELL).orderBy("time_ms", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return coded(ticks(spark, d)).select(day(), "symbol", "minute_code", "pos", F.sum("volume").over(w).alias("running"))


def q_O6_sampled_days(spark: SparkSession, d: str) -> DataFrame:
    """Up to five evenly spaced days."""
    from gridloom.plans.runner import sampled_days

    return sampled_days(trades(spark, d).select(day().alias("day"))).select(F.col("day").alias("trade_date"))


def q_C6_chain_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Entropy in one pass against entropy by shares: cells that differ by more than the chain's tolerance (none)."""
    from pyspark.sql import Window

    cells = coded(trades(spark, d))
    w = Window.partitionBy(*CELL)
    p = F.col("volume") / F.sum("volume").over(w)
    shares = cells.select(*CELL, p.alias("p")).groupBy(*CELL).agg(F.greatest(F.lit(0.0), -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")))).alias("h"))
    once = cells.groupBy(*CELL).agg(aggs.entropy(F.col("volume")).alias("h"))
    return out(verify.compare(shares, once, "h", verify.CHAIN_RTOL, verify.CHAIN_ATOL, CELL))


def q_C7_preflight(spark: SparkSession, d: str) -> DataFrame:
    """The first day of trades against a universe of two symbols, as the SQL has it; all days and tables: ``q_C7_preflight_days``."""
    first = trades(spark, d).agg(F.min("trade_date")).first()[0]
    return verify.preflight(trades(spark, d).where(F.col("trade_date") == first), ["000000.XSHE", "999999.XSHG"], str(first))


TICKS = ("weituo", "chengjiao", "chedan")


def q_C7_preflight_days(spark: SparkSession, d: str) -> DataFrame:
    """Every day of every tick table against the symbols and days of the other two."""
    return verify.preflight_days({n: table(spark, d, n) for n in TICKS}).withColumn("trade_date", day())


def q_C7_footers(spark: SparkSession, d: str) -> DataFrame:
    """File keys and types of all files of the tick tables that are not the input contract's."""
    found = [verify.footer_faults(spark, table(spark, d, n).inputFiles()).select(F.lit(n).alias("table_name"), "*") for n in TICKS]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- publication: resume, overwrite, schema, validation


def _published(spark: SparkSession, d: str):  # noqa: ANN202
    """Folder of a publication of ``trade_volume_min``: first the days that ``minute_volume`` has, then what resuming finds pending."""
    import uuid

    from gridloom.session import checkpoint_dir
    from gridloom.sources import published

    root = f"{checkpoint_dir(spark).removeprefix('file://')}/publish-{uuid.uuid4().hex}"
    dense = metric.labelled(_dense(spark, d, "trades_basic").select(*CELL, "trade_volume_min"))
    early = table(spark, d, "minute_volume").select("trade_date").distinct()
    published.write_days(dense.join(early, "trade_date", "left_semi"), root, "trade_volume_min", published.RunConfig(d, root))
    return root, dense


def q_R3_resume(spark: SparkSession, d: str) -> DataFrame:
    """Rows per day after a publication of the early days and a resumed one: ``run`` says which of the two wrote the day."""
    from gridloom.sources import published

    root, dense = _published(spark, d)
    config = published.RunConfig(d, root, resume=True)
    first = published.published_dates(root, "trade_volume_min")
    wanted = [r[0] for r in trades(spark, d).select(F.date_format("trade_date", "yyyyMMdd")).distinct().collect()]  # a short text a day
    todo = published.pending_dates(wanted, first, config)
    if todo:
        published.write_days(dense.where(F.date_format("trade_date", "yyyyMMdd").isin(todo)), root, "trade_volume_min", config)
    back = published.read_metric(spark, root, "trade_volume_min").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("trade_volume_min").alias("volume"))
    return back.select(day(), F.when(F.date_format("trade_date", "yyyyMMdd").isin(first), 1).otherwise(2).alias("run"), "n_rows", "volume")


def q_R4_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Volume per day after the first day was published again with doubled values: the other days stay as they were."""
    from gridloom.sources import published

    root, dense = _published(spark, d)
    first = table(spark, d, "minute_volume").agg(F.min("trade_date")).first()[0]
    published.write_days(dense.where(F.col("trade_date") == first).withColumn("trade_volume_min", F.col("trade_volume_min") * 2), root, "trade_volume_min", published.RunConfig(d, root, overwrite_dates=True))
    return published.read_metric(spark, root, "trade_volume_min").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("trade_volume_min").alias("volume")).select(day(), "n_rows", "volume")


def q_C1_schema(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the published table's schema against the strict form."""
    wanted = [("trade_date", "date", False), ("minute", "timestamp_ntz", False), ("symbol", "string", False), ("trade_volume_min", "bigint", True)]
    found = verify.schema_problems(table(spark, d, "minute_volume"), wanted)
    return spark.createDataFrame([(x,) for x in found], "problem string")


def q_C4_validate(spark: SparkSession, d: str) -> DataFrame:
    """Problems of the published metric by kind, held against values computed again from trades."""
    actual = table(spark, d, "minute_volume").select("trade_date", "minute", "symbol", "trade_volume_min")
    return verify.compare_summary(_expected_volume(spark, d), actual, "trade_volume_min").select("problem", "n")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
