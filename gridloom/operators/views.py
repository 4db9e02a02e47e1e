"""Order views: complete orders from fragments, and the orders that take part in trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.aggs import BUY, SELL
from gridloom.functions.axis import minute_code_unchecked

ORDER_KEY = ("symbol", "channel", "side", "order_num")


def aggregate_order_fragments(df: DataFrame, key: Sequence[str] = ORDER_KEY, date: str = "trade_date", volume: str | None = "volume", money: str | None = "money", use_channel: bool = True) -> DataFrame:
    """V1: one row per order - earliest time, whole volume, known money - *before* any minute is cut.

    ``time_ms`` is the earliest, ``volume`` the sum (a negative or null fragment raises), ``money`` the sum of known fragments
    (null if none is known), ``n_fragments`` and ``n_known_money`` what V2 needs. All fragments of a day must be in the input;
    several days may be (the date is part of the key). ``use_channel=False`` leaves the channel out of the identity.
    """
    keys = [date, *[k for k in key if use_channel or k != "channel"]]
    aggs = [F.min("time_ms").alias("time_ms"), F.count(F.lit(1)).alias("n_fragments")]
    if volume:
        v = F.col(volume)
        aggs.append(F.sum(F.when(v.isNull() | (v < 0), F.raise_error(F.lit("order fragment without a valid volume")).cast("bigint")).otherwise(v.cast("bigint"))).alias("volume"))
    if money:
        aggs += [F.sum(money).alias("money"), F.count(money).alias("n_known_money")]
    return df.groupBy(*keys).agg(*aggs)


def fragment_quality(orders: DataFrame, by: Sequence[str] = ("trade_date",)) -> DataFrame:
    """Report on the result of V1, per ``by``: fragments, orders, and where money is unknown, wholly or in part."""
    unknown = F.col("n_known_money") == 0
    part = F.col("n_fragments") - F.col("n_known_money")
    return orders.groupBy(*by).agg(
        F.sum("n_fragments").alias("input_fragments"),
        F.count(F.lit(1)).alias("orders"),
        F.sum(part).alias("unknown_money_fragments"),
        F.count(F.when(unknown, 1)).alias("unknown_money_orders"),
        F.coalesce(F.sum(F.when(unknown, F.col("volume"))), F.lit(0)).alias("unknown_money_volume"),
        F.count(F.when(~unknown & (part > 0), 1)).alias("mixed_money_orders"),
    )


def legs(df: DataFrame, side: str = "both") -> DataFrame:
    """Buy and sell legs of trades in one pass over them: ``order_side, order_num`` added, order numbers of 0 and less dropped."""
    if side not in {"buy", "sell", "both"}:
        raise ValueError(f"side must be buy, sell or both: {side}")
    parts = []
    if side in {"buy", "both"}:
        parts.append(F.struct(F.lit(BUY).alias("order_side"), F.col("buy_order_num").cast("long").alias("order_num")))
    if side in {"sell", "both"}:
        parts.append(F.struct(F.lit(SELL).alias("order_side"), F.col("sell_order_num").cast("long").alias("order_num")))
    return df.withColumn("__leg", F.explode(F.array(*parts))).select(*[c for c in df.columns if c not in {"order_side", "order_num"}], "__leg.order_side", "__leg.order_num").where("order_num > 0")


def trade_order_participation(df: DataFrame, side: str = "both", scope: str = "first_event", date: str = "trade_date", use_channel: bool = True) -> DataFrame:
    """V3/V4: orders that take part in trades, ``date, symbol, channel, order_side, order_num, time_ms`` (and ``minute_code``).

    ``first_event``: once per day at the earliest trade. ``per_minute``: once per minute with a trade, pre- and post-market
    folded in, lunch dropped. No volume or money is carried: a trade belongs to two orders.
    """
    keys = [date, "symbol", *(["channel"] if use_channel else []), "order_side", "order_num"]
    both = legs(df, side)
    if scope == "first_event":
        return both.groupBy(*keys).agg(F.min("time_ms").alias("time_ms"))
    if scope != "per_minute":
        raise ValueError(f"unknown scope {scope}")
    coded = both.withColumn("minute_code", minute_code_unchecked(F.col("time_ms"), True, True)).where("minute_code >= 0")
    return coded.groupBy(*keys, "minute_code").agg(F.min("time_ms").alias("time_ms"))
