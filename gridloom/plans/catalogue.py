"""Metrics that come with the engine: basic, block-style and derived ones over orders, trades and both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import aggs
from gridloom.operators import views
from gridloom.operators.metric import MetricGroup, MetricSpec

SOURCE_ORDER = ("time_ms", "recv_time", "load_id", "price", "volume")


def trades_basic() -> MetricGroup:
    """Volume, count (empty 0), count (empty null), distinct buy orders, known money: one scan of trades."""
    return MetricGroup(
        (
            MetricSpec("trade_volume_min", lambda: aggs.sum_int(F.col("volume"))),
            MetricSpec("trade_count_min", aggs.count_rows),
            MetricSpec("nullable_trade_count_min", aggs.count_rows, empty_value=None),
            MetricSpec("block_orders_min", lambda: aggs.distinct_count(F.col("buy_order_num"))),
            MetricSpec("block_money_min", lambda: F.sum("money"), empty_value=None),
        )
    )


def orders_basic() -> MetricGroup:
    """Order fragments: count, volume and known money (0 for an empty cell, null where no money is known)."""
    return MetricGroup(
        (
            MetricSpec("order_count_min", aggs.count_rows, inputs=("weituo",)),
            MetricSpec("order_volume_min", lambda: aggs.sum_int(F.col("volume")), inputs=("weituo",), empty_value=None),
            MetricSpec("known_money_min", lambda: F.sum(F.col("money").cast("double") / 10000), "float64", 0.0, ("weituo",)),
        )
    )


def whole_orders() -> MetricGroup:
    """Orders put together from fragments before they are cut into minutes. Fragments with a null volume count with 0."""

    def prepare(inputs: dict[str, DataFrame]) -> DataFrame:
        return views.aggregate_order_fragments(inputs["weituo"].withColumn("volume", F.coalesce("volume", F.lit(0))))

    return MetricGroup((MetricSpec("whole_order_count_min", aggs.count_rows, inputs=("weituo",)), MetricSpec("whole_order_volume_min", lambda: aggs.sum_int(F.col("volume")), inputs=("weituo",))), prepare)


def participation() -> MetricGroup:
    """Orders taking part in trades, once per minute."""

    def prepare(inputs: dict[str, DataFrame]) -> DataFrame:
        return views.trade_order_participation(inputs["chengjiao"].where(F.col("time_ms") < 86_400_000), scope="per_minute").drop("minute_code")

    return MetricGroup((MetricSpec("participating_order_count_min", aggs.count_rows, empty_value=None),), prepare, include_post_market=True)


def orders_and_trades() -> MetricGroup:
    """Events of both tables as one stream."""

    def prepare(inputs: dict[str, DataFrame]) -> DataFrame:
        columns = ["trade_date", "symbol", "time_ms", "volume"]
        return inputs["weituo"].select(*columns).unionByName(inputs["chengjiao"].select(*columns))

    both = ("weituo", "chengjiao")
    return MetricGroup((MetricSpec("multi_table_count_min", aggs.count_rows, inputs=both), MetricSpec("multi_table_volume_min", lambda: aggs.sum_int(F.col("volume")), inputs=both)), prepare)


def prices() -> MetricGroup:
    """Open, high, low, close of known prices, in order of time with full tie-breaks."""
    o = aggs.ohlc(F.col("price"), SOURCE_ORDER)
    return MetricGroup(tuple(MetricSpec(f"{n}_price_min", lambda c=c: c, empty_value=None) for n, c in zip(("open", "high", "low", "close"), o, strict=True)))


def shape() -> MetricGroup:
    """Entropy of volume, time centres, buy-side volume."""
    v, t = F.col("volume"), F.col("time_ms")
    return MetricGroup(
        (
            MetricSpec("volume_entropy_min", lambda: aggs.entropy(v), "float64", None),
            MetricSpec("time_centre_min", lambda: aggs.time_centre(t), "float64", None),
            MetricSpec("volume_centre_min", lambda: aggs.time_centre(t, v), "float64", None),
            MetricSpec("buy_volume_min", lambda: aggs.side_sum(v, F.col("side")), empty_value=None),
        )
    )


#: Groups by name, as run plans refer to them.
GROUPS = {"trades_basic": trades_basic, "orders_basic": orders_basic, "whole_orders": whole_orders, "participation": participation, "orders_and_trades": orders_and_trades, "prices": prices, "shape": shape}
