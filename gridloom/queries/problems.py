"""Queries of the general problems 1-5 and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.axis import axis_position, minute_code_unchecked
from gridloom.operators import drift, eager, gridfit, intervals, profile
from gridloom.session import checkpoint_dir, stored, table

DATE = "yyyy-MM-dd"


def date_text(name: str = "trade_date"):  # noqa: ANN201
    return F.date_format(F.col(name), DATE).alias(name)


# --- problem 1: a few keys holding most records


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    shares = eager.key_shares({n: table(spark, d, n) for n in ("weituo", "chengjiao")}, "trade_date", "symbol")
    return shares.where(F.col("n_rows") * 20 > F.col("n_total")).select("table_name", date_text(), "symbol")


def p1_symbol_day(spark: SparkSession, d: str) -> DataFrame:
    """Orders joined with trades of their symbol and day, aggregated without the join (a heavy symbol would give billions of pairs)."""
    pairs = eager.eager_join_aggregate(
        table(spark, d, "weituo"),
        table(spark, d, "chengjiao"),
        ["trade_date", "symbol"],
        ["trade_date", "symbol"],
        [
            eager.PairAgg("n_pairs", "count"),
            eager.PairAgg("order_volume", "sum_left", left="volume"),
            eager.PairAgg("trade_volume", "sum_right", right="volume"),
            eager.PairAgg("max_order_price", "max_left", left="price"),
            eager.PairAgg("min_trade_price", "min_right", right="price"),
        ],
    )
    return pairs.select(date_text(), "symbol", *[F.col(c).cast("bigint").alias(c) for c in ("n_pairs", "order_volume", "trade_volume", "max_order_price", "min_trade_price")])


def p1_fill_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Trades joined with the buy order they fill, rolled up to the order's symbol and side."""
    trades = table(spark, d, "chengjiao").where("buy_order_num > 0")
    fills = eager.eager_join_aggregate(
        table(spark, d, "weituo"),
        trades,
        ["trade_date", "channel", "order_num"],
        ["trade_date", "channel", "buy_order_num"],
        [eager.PairAgg("n_fills", "count"), eager.PairAgg("filled_volume", "sum_right", right="volume"), eager.PairAgg("asked_volume", "sum_left", left="volume")],
        by_left=["symbol", "side"],
    )
    return fills.select("symbol", F.col("side").cast("int").alias("side"), *[F.col(c).cast("bigint").alias(c) for c in ("n_fills", "filled_volume", "asked_volume")])


# --- problem 2: irregular readings onto a regular grid


def trade_grid(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "chengjiao")
    code = minute_code_unchecked(F.col("time_ms"))
    value = F.when(F.col("price") > 0, F.col("price"))
    return gridfit.grid_regression(trades, ["trade_date", "symbol"], code, axis_position(F.col("time_ms"), code), value)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    runs = gridfit.empty_runs(trade_grid(spark, d), ["trade_date", "symbol"], 15)
    return runs.select(date_text(), "symbol", F.col("first_cell").alias("first_code"), F.col("last_cell").alias("last_code"))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every (day, symbol, minute): trades, effective support and the local price."""
    grid = trade_grid(spark, d)
    return grid.select(date_text(), "symbol", F.col("cell").alias("minute_code"), "n_obs", F.round("n_eff", 4).alias("n_eff"), F.round(F.col("estimate") / 10000, 4).alias("price"), "mark")


# --- problem 3: processing only new or changed records


#: Which day files each metric reads.
METRIC_INPUT = {"trade_volume_min": "chengjiao", "trade_count_min": "chengjiao", "order_count_min": "weituo"}


def _ledger(spark: SparkSession, d: str) -> intervals.Ledger:
    """A ledger that has taken over what earlier runs processed."""
    ledger = intervals.Ledger(spark, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}", ["metric_name"])
    ledger.adopt(intervals.processed_deliveries(table(spark, d, "day_file"), table(spark, d, "run_log"), METRIC_INPUT), "file_id")
    return ledger


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Current deliveries whose file numbers no processed interval covers."""
    available = stored(intervals.current_deliveries(table(spark, d, "day_file"), METRIC_INPUT))
    gaps = stored(_ledger(spark, d).gaps(available, "file_id"))
    return intervals.records_in(available, gaps, ["metric_name"], "file_id").select("metric_name", date_text(), "channel")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over the ledger: one in the middle of the time of deliveries, which fails at first, and one at the end, which
    also takes late files of the dates before. Every pending file is processed once: ``metric_name, trade_date, channel, file_id, run``."""
    ledger, files = _ledger(spark, d), table(spark, d, "day_file")
    first, last = files.agg(F.min("delivered_at"), F.max("delivered_at")).first()
    middle = first + (last - first) // 2 if first else first
    early = stored(intervals.current_deliveries(files.where(F.col("delivered_at") <= F.lit(middle)), METRIC_INPUT))

    def lost(_: DataFrame) -> DataFrame:
        raise ConnectionError("the run breaks off")

    try:
        ledger.run(early, "file_id", lost)
    except ConnectionError:
        pass
    for run, available in ((1, early), (2, stored(intervals.current_deliveries(files, METRIC_INPUT)))):
        ledger.run(available, "file_id", lambda new, run=run: new.withColumn("run", F.lit(run)))
    done = ledger.output()
    if done is None:
        return early.limit(0).select("metric_name", date_text(), "channel", "file_id", F.lit(0).alias("run"))
    return done.select("metric_name", date_text(), "channel", "file_id", "run")


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Delivered file numbers of each dataset as disjoint intervals."""
    files = table(spark, d, "day_file")
    return intervals.compact(intervals.to_intervals(files, ["dataset"], "file_id"), ["dataset"])


# --- problem 4: schemas that drift between files


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "weituo_raw"), table(spark, d, "day_file"))


def p4_orders(spark: SparkSession, d: str) -> DataFrame:
    """All raw order lines as one table under the canonical names and types."""
    raw = table(spark, d, "weituo_raw")
    history = drift.schema_history(raw, table(spark, d, "day_file"))
    return drift.unify(raw, history, drift.ORDER_COLUMNS).withColumn("trade_date", date_text())


# --- problem 5: column-level data quality profile


P5_COLUMNS = {"weituo": ["money", "volume"], "chengjiao": ["price"]}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_issues({n: (table(spark, d, n), c) for n, c in P5_COLUMNS.items()})


def p5_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Column chunks that footers and dictionaries decide for ``p5_found``, and those that it scans."""
    parts = [profile.chunk_evidence(table(spark, d, n), "load_id", c).select(F.lit(n).alias("table_name"), "*") for n, c in P5_COLUMNS.items()]
    return parts[0].unionByName(parts[1]).groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n_chunks"), *[F.count(F.when(F.col("by") == k, 1)).alias(f"n_{k}") for k in ("footer", "dictionary", "scan")], F.sum("n_rows").alias("n_rows"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile over all rows of every column of both tables, mostly from footers and dictionaries."""
    out = None
    for name in P5_COLUMNS:
        df = table(spark, d, name)
        part = profile.profile_columns(df, df.columns, {"symbol": r"\d{6}\.XSH[GE]", "side": "49|50"}).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out.drop("n_chunks", "n_scanned")


QUERIES = {f.__name__: f for f in (p1_found, p1_symbol_day, p1_fill_by_symbol, p2_found, p2_grid, p3_found, p3_runs, p3_intervals, p4_found, p4_orders, p5_found, p5_chunks, p5_profile)}
