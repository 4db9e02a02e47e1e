"""SQL of the inventory's queries."""

from __future__ import annotations

from gridloom.queries.problems_sql import DATE, code_sql

TICKS = """ticks AS (SELECT CAST(ts AS DATE) AS trade_date, event_type AS symbol,
  CAST(extract(hour FROM ts) * 3600000 + extract(minute FROM ts) * 60000 + extract(microseconds FROM ts) // 1000 AS BIGINT) AS time_ms, event_id AS pos, user_id % 4 AS channel, 49 + event_id % 2 AS side,
  user_id, user_id AS order_num, CAST(round(value * 100) AS BIGINT) AS volume, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 5 <> 0 THEN CAST(round(value * 100) AS BIGINT) * CAST(json_extract(props, '$.k') AS BIGINT) END AS money FROM events)"""


def coded(source: str, name: str = "c", pre: bool = True, post: bool = False) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, CAST({code_sql('time_ms', pre, post)} AS INTEGER) AS minute_code FROM {source}) WHERE minute_code >= 0)"


def universe(*tables: str) -> str:
    return "u AS (" + " UNION ".join(f"SELECT DISTINCT trade_date, symbol FROM {t}" for t in tables) + ")"


GRID = "g AS (SELECT u.trade_date, u.symbol, CAST(m.m AS INTEGER) AS minute_code FROM u, range(242) m(m))"


def dense(source: str, tables: tuple[str, ...], columns: dict[str, tuple[str, str]], ctes: str = "", post: bool = False) -> str:
    """columns: name -> (aggregate, value of an empty cell)."""
    picks = ", ".join(f"CASE WHEN s.n__ IS NULL THEN {empty} ELSE s.{n} END AS {n}" for n, (_, empty) in columns.items())
    sums = ", ".join(f"{a} AS {n}" for n, (a, _) in columns.items())
    return f"""WITH {ctes + ',' if ctes else ''} {coded(source, post=post)}, {universe(*tables)}, {GRID},
    s AS (SELECT trade_date, symbol, minute_code, count(*) AS n__, {sums} FROM c GROUP BY ALL)
    SELECT strftime(g.trade_date, '%Y-%m-%d') AS trade_date, g.symbol AS symbol, g.minute_code AS minute_code, {picks}
    FROM g LEFT JOIN s ON g.trade_date = s.trade_date AND g.symbol = s.symbol AND g.minute_code = s.minute_code"""


def cells(source: str, columns: str, ctes: str = "") -> str:
    return f"WITH {ctes + ',' if ctes else ''} {coded(source)} SELECT {DATE}, symbol, minute_code, {columns} FROM c GROUP BY c.trade_date, symbol, minute_code"


PAIRS = [(pre, post) for pre in (True, False) for post in (True, False)]
WHOLE = "whole AS (SELECT trade_date, symbol, channel, side, order_num, min(time_ms) AS time_ms, CAST(sum(coalesce(volume, 0)) AS BIGINT) AS volume, CAST(sum(money) AS BIGINT) AS money, count(*) AS n_fragments, count(money) AS n_known FROM weituo GROUP BY ALL)"
LEGS = "legs AS (SELECT trade_date, symbol, channel, time_ms, 49 AS order_side, CAST(buy_order_num AS BIGINT) AS order_num FROM chengjiao WHERE buy_order_num > 0 UNION ALL SELECT trade_date, symbol, channel, time_ms, 50, CAST(sell_order_num AS BIGINT) FROM chengjiao WHERE sell_order_num > 0)"
ORDER = "(time_ms, recv_time, load_id, price, volume)"
LABEL = "CASE WHEN {c} < 121 THEN 570 + {c} ELSE 659 + {c} END"
LABEL_CODE = "CASE WHEN second(minute) = 0 AND hour(minute) * 60 + minute(minute) BETWEEN 570 AND 690 THEN hour(minute) * 60 + minute(minute) - 570 WHEN second(minute) = 0 AND hour(minute) * 60 + minute(minute) BETWEEN 780 AND 900 THEN hour(minute) * 60 + minute(minute) - 780 + 121 ELSE -1 END"

SQL = {
    "q_F1_minute_codes": "SELECT time_ms, " + ", ".join(f"CAST({code_sql('time_ms', a, b)} AS INTEGER) AS code_{int(a)}{int(b)}" for a, b in PAIRS) + " FROM (SELECT DISTINCT time_ms FROM chengjiao)",
    "q_F3_timestamp_codes": f"WITH {TICKS} SELECT pos AS event_id, CAST({code_sql('time_ms')} AS INTEGER) AS code FROM ticks",
    "q_F4_labels": f"SELECT strftime(trade_date, '%Y-%m-%d') AS trade_date, CAST(m AS INTEGER) AS code, strftime(trade_date + to_minutes(CAST({LABEL.format(c='m')} AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS label FROM (SELECT DISTINCT trade_date FROM chengjiao), range(242) r(m)",
    "q_F5_milliseconds": f"WITH {TICKS} SELECT pos AS event_id, time_ms FROM ticks",
    "q_F6_scales": f"SELECT {DATE}, channel, order_num, strftime(recv_time, '%Y-%m-%d %H:%M:%S.%f') AS recv_time, price / 10000.0::DOUBLE AS price, money / 10000.0::DOUBLE AS money, (price / 10000.0::DOUBLE) * volume::DOUBLE AS derived_money FROM weituo",
    "q_F8_types": "SELECT CASE type WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN 'U' WHEN 50 THEN '50' WHEN 85 THEN '85' END AS type_text, count(*) AS n FROM weituo GROUP BY 1",
    "q_F9_raw_prices": "SELECT symbol, CAST(sum(price) AS BIGINT) AS raw_sum FROM chengjiao GROUP BY 1",
    "q_F10_packed_keys": f"SELECT {DATE}, CAST(channel AS BIGINT) * 1099511627776 + CAST(order_num AS BIGINT) * 256 + side AS packed, count(*) AS n FROM weituo GROUP BY weituo.trade_date, 2",
    "q_F11_cell_keys": f"WITH {coded('chengjiao')} SELECT CAST(regexp_extract(symbol, '^(\\d+)', 1) AS BIGINT) * 242 + minute_code AS cell, count(*) AS n FROM c GROUP BY 1",
    "q_F12_text": "SELECT DISTINCT symbol FROM chengjiao",
    "q_F14_digests": "SELECT file_id, sha256(file_id::VARCHAR || '|' || content_digest) AS digest FROM day_file",
    "q_P2_on_axis": f"WITH {coded('chengjiao')} SELECT {DATE}, minute_code, count(*) AS n FROM c GROUP BY c.trade_date, minute_code",
    "q_P3_market_switches": f"SELECT {DATE}, " + ", ".join(f"count(*) FILTER (WHERE {code_sql('time_ms', a, b)} >= 0) AS n_{int(a)}{int(b)}" for a, b in PAIRS) + " FROM chengjiao GROUP BY chengjiao.trade_date",
    "q_P4_order_numbers": f"WITH {LEGS} SELECT {DATE}, CAST(channel AS INTEGER) AS channel, order_side, count(*) AS n FROM legs GROUP BY legs.trade_date, legs.channel, order_side",
    "q_P6_sides": f"SELECT {DATE}, symbol, CAST(sum(volume) FILTER (WHERE side = 49) AS BIGINT) AS buy_volume, CAST(sum(volume) FILTER (WHERE side = 50) AS BIGINT) AS sell_volume FROM weituo GROUP BY weituo.trade_date, symbol",
    "q_P7_session": f"SELECT {DATE}, symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM chengjiao WHERE (time_ms >= 34200000 AND time_ms < 41400000) OR (time_ms >= 46800000 AND time_ms < 53820000) GROUP BY chengjiao.trade_date, symbol",
    "q_P8_amounts": f"SELECT {DATE}, count(*) FILTER (WHERE money < 0) AS bad_money, count(*) FILTER (WHERE price < 0) AS bad_price, count(*) FILTER (WHERE money IS NULL OR money < 0) AS bad_or_missing_money FROM weituo GROUP BY weituo.trade_date",
    "q_J1_dense_minute": dense("ticks", ("ticks",), {"volume_min": ("CAST(sum(volume) AS BIGINT)", "0"), "count_min": ("count(*)", "0"), "users_min": ("count(DISTINCT user_id)", "NULL")}, TICKS),
    "q_D11_trades_basic": dense(
        "chengjiao", ("chengjiao",), {"trade_volume_min": ("CAST(sum(volume) AS BIGINT)", "0"), "trade_count_min": ("count(*)", "0"), "nullable_trade_count_min": ("count(*)", "NULL"), "block_orders_min": ("count(DISTINCT buy_order_num)", "0"), "block_money_min": ("CAST(sum(money) AS BIGINT)", "NULL")}
    ),
    "q_A12_orders_basic": dense("weituo", ("weituo",), {"order_count_min": ("count(*)", "0"), "order_volume_min": ("CAST(sum(volume) AS BIGINT)", "NULL"), "known_money_min": ("round(sum(money) / 10000.0::DOUBLE, 4)", "0.0")}),
    "q_A3_volume_u64": cells("chengjiao", "CAST(sum(volume) AS BIGINT) AS volume"),
    "q_A4_sum_float": "SELECT symbol, round(sum(money) / 10000.0::DOUBLE, 2) AS money FROM chengjiao GROUP BY 1",
    "q_A6_ohlc": f"WITH {coded('chengjiao')} SELECT {DATE}, symbol, minute_code, arg_min(price, {ORDER}) AS open_price_min, max(price) AS high_price_min, min(price) AS low_price_min, arg_max(price, {ORDER}) AS close_price_min FROM c WHERE price IS NOT NULL GROUP BY c.trade_date, symbol, minute_code",
    "q_A8_first_last": cells("ticks", "arg_min(volume, (time_ms, pos)) AS first_volume, arg_max(volume, (time_ms, pos)) AS last_volume, min(volume) AS min_volume, max(volume) AS max_volume", TICKS),
    "q_A10_distinct_orders": cells("chengjiao", "count(DISTINCT buy_order_num) AS buyers, count(DISTINCT sell_order_num) AS sellers"),
    "q_A11_group_take": f"WITH {TICKS} SELECT channel, side, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n, arg_min(order_num, pos) AS first_order FROM ticks GROUP BY ALL",
    "q_A13_cell_reducer": cells("ticks", "max(volume) - min(volume) AS volume_range", TICKS),
    "q_A14_universe": f"WITH {universe('weituo', 'chengjiao', 'chedan')} SELECT {DATE}, symbol FROM u",
    "q_J3_scatter": f"WITH {coded('chengjiao')}, s AS (SELECT minute_code, count(*) AS n FROM c GROUP BY ALL) SELECT m AS code, coalesce(n, -1) AS n FROM range(242) r(m) LEFT JOIN s ON m = minute_code",
    "q_J4_share_of_group": f"SELECT {DATE}, symbol, CAST(channel AS INTEGER) AS channel, order_num, strftime(recv_time, '%Y-%m-%d %H:%M:%S.%f') AS recv_time, volume, CAST(sum(volume) OVER w AS BIGINT) AS total, max(volume) OVER w AS largest FROM weituo WINDOW w AS (PARTITION BY weituo.trade_date, symbol)",
    "q_W1_path_extremes": f"""WITH {TICKS}, {coded('ticks')}, p AS (SELECT trade_date, symbol, minute_code, volume, money,
      sum(CASE side WHEN 49 THEN 1 ELSE -1 END) OVER w AS d, sum(CASE side WHEN 49 THEN volume ELSE -volume END) OVER w AS v, sum(CASE side WHEN 49 THEN coalesce(money, 0) ELSE -coalesce(money, 0) END) OVER w AS m
      FROM c WINDOW w AS (PARTITION BY trade_date, symbol, minute_code ORDER BY time_ms, pos ROWS UNBOUNDED PRECEDING))
      SELECT {DATE}, symbol, minute_code, """
    + ", ".join(
        f"{k}CAST(greatest(0, max({n})) AS BIGINT){e} AS {n}_buy, {k}CAST(greatest(0, -min({n})) AS BIGINT){e} AS {n}_sell, {k}CAST(greatest(0, max({n})) + greatest(0, -min({n})) AS BIGINT){e} AS {n}_abs"
        for n, k, e in (("d", "", ""), ("v", "", ""), ("m", "CASE WHEN count(money) > 0 THEN ", " END"))
    )
    + " FROM p GROUP BY p.trade_date, symbol, minute_code",
    "q_W2_shape": f"""WITH {coded('chengjiao')}, t AS (SELECT *, sum(volume) OVER (PARTITION BY trade_date, symbol, minute_code) AS total FROM c)
      SELECT {DATE}, symbol, minute_code, floor(greatest(0, -sum(CASE WHEN volume > 0 THEN volume / total * ln(volume / total) END)) * 1e6 + 0.5) / 1e6 AS volume_entropy_min,
      floor(sum(time_ms % 60000) / count(*) / 1000.0::DOUBLE * 1e6 + 0.5) / 1e6 AS time_centre_min, floor(sum(volume * (time_ms % 60000)::BIGINT) / nullif(sum(volume), 0) / 1000.0::DOUBLE * 1e6 + 0.5) / 1e6 AS volume_centre_min,
      CAST(coalesce(sum(volume) FILTER (WHERE side = 49), 0) AS BIGINT) AS buy_volume_min FROM t GROUP BY t.trade_date, symbol, minute_code""",
    "q_V1_fragments": f"WITH {WHOLE} SELECT {DATE}, symbol, CAST(channel AS INTEGER) AS channel, CAST(side AS INTEGER) AS side, order_num, time_ms, volume, money::VARCHAR AS money, n_fragments FROM whole",
    "q_V2_quality": f"""WITH {WHOLE} SELECT {DATE}, CAST(sum(n_fragments) AS BIGINT) AS input_fragments, count(*) AS orders, CAST(sum(n_fragments - n_known) AS BIGINT) AS unknown_money_fragments, count(*) FILTER (WHERE n_known = 0) AS unknown_money_orders,
      CAST(coalesce(sum(volume) FILTER (WHERE n_known = 0), 0) AS BIGINT) AS unknown_money_volume, count(*) FILTER (WHERE n_known > 0 AND n_known < n_fragments) AS mixed_money_orders FROM whole GROUP BY whole.trade_date""",
    "q_V3_participation": f"WITH {LEGS} SELECT {DATE}, symbol, CAST(channel AS INTEGER) AS channel, order_side, order_num, min(time_ms) AS time_ms FROM legs GROUP BY legs.trade_date, symbol, legs.channel, order_side, order_num",
    "q_V4_participation_minute": f"""WITH {LEGS}, {coded('legs', post=True)} SELECT {DATE}, symbol, minute_code, count(*) AS participating_order_count_min
      FROM (SELECT DISTINCT trade_date, symbol, channel, order_side, order_num, minute_code FROM c) x GROUP BY x.trade_date, symbol, minute_code""",
    "q_V5_whole_orders": dense("whole", ("weituo",), {"whole_order_count_min": ("count(*)", "0"), "whole_order_volume_min": ("CAST(sum(volume) AS BIGINT)", "0")}, WHOLE),
    "q_U1_orders_and_trades": dense("both_tables", ("weituo", "chengjiao"), {"multi_table_count_min": ("count(*)", "0"), "multi_table_volume_min": ("CAST(sum(volume) AS BIGINT)", "0")}, "both_tables AS (SELECT trade_date, symbol, time_ms, volume FROM weituo UNION ALL SELECT trade_date, symbol, time_ms, volume FROM chengjiao)"),
    "q_U2_legs": f"WITH {LEGS} SELECT {DATE}, order_side, count(*) AS n, count(DISTINCT (channel, order_num)) AS orders FROM legs GROUP BY legs.trade_date, order_side",
    "q_U3_all_dates": f"SELECT {DATE} FROM (SELECT trade_date FROM weituo UNION SELECT trade_date FROM chengjiao UNION SELECT trade_date FROM chedan UNION SELECT trade_date FROM minute_volume)",
    "q_U4_missing_dates": f"SELECT {DATE} FROM (SELECT trade_date FROM chengjiao EXCEPT SELECT trade_date FROM minute_volume)",
    "q_U5_common_symbols": f"SELECT {DATE}, symbol FROM (SELECT trade_date, symbol FROM weituo INTERSECT SELECT trade_date, symbol FROM chengjiao INTERSECT SELECT trade_date, symbol FROM chedan)",
    "q_O4_order_view": f"""SELECT {DATE}, symbol, CAST(channel AS INTEGER) AS channel, order_num, CAST(side AS INTEGER) AS side, time_ms, CAST(row_number() OVER (PARTITION BY w.trade_date, w.channel ORDER BY time_ms, order_num, symbol, w.side) AS INTEGER) AS place
      FROM (SELECT trade_date, symbol, channel, side, order_num, min(time_ms) AS time_ms FROM weituo GROUP BY ALL) w""",
    "q_O5_representative_days": "WITH n AS (SELECT trade_date, count(*) AS n FROM chengjiao GROUP BY 1) SELECT DISTINCT strftime(t, '%Y-%m-%d') AS trade_date FROM (SELECT arg_max(trade_date, (n, trade_date)) AS t FROM n UNION ALL SELECT min(trade_date) FROM n UNION ALL SELECT max(trade_date) FROM n)",
    "q_S7_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("weituo", "chengjiao", "chedan", "minute_volume")),
    "q_S8_published_dates": f"SELECT DISTINCT {DATE} FROM minute_volume",
    "q_C3_published_differences": f"""WITH {coded('chengjiao')}, e AS (SELECT trade_date, symbol, trade_date + to_minutes(CAST({LABEL.format(c='minute_code')} AS BIGINT)) AS minute, CAST(sum(volume) AS BIGINT) AS v
        FROM c WHERE trade_date IN (SELECT trade_date FROM minute_volume) GROUP BY ALL), a AS (SELECT trade_date, minute, symbol, count(*) AS n, max(trade_volume_min) AS v FROM minute_volume GROUP BY ALL)
      SELECT strftime(coalesce(e.trade_date, a.trade_date), '%Y-%m-%d') AS trade_date, strftime(coalesce(e.minute, a.minute), '%Y-%m-%d %H:%M:%S') AS minute, coalesce(e.symbol, a.symbol) AS symbol, e.v AS expected, a.v AS actual,
        CASE WHEN a.n IS NULL THEN 'missing' WHEN e.trade_date IS NULL THEN 'extra' WHEN a.n > 1 THEN 'repeated' WHEN (e.v IS NULL) <> (a.v IS NULL) THEN 'null' ELSE 'differs' END AS problem
      FROM e FULL JOIN a ON e.trade_date = a.trade_date AND e.minute = a.minute AND e.symbol = a.symbol WHERE a.n IS NULL OR e.trade_date IS NULL OR a.n > 1 OR e.v IS DISTINCT FROM a.v""",
    "q_C2_structure": f"""SELECT {DATE}, CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT symbol) AS n_symbols, count(*) AS n_cells, sum(n) = count(DISTINCT symbol) * 242 AND count(*) = count(DISTINCT symbol) * 242 AS complete
      FROM (SELECT trade_date, symbol, minute, count(*) AS n FROM minute_volume GROUP BY ALL) x GROUP BY x.trade_date""",
    "q_C2_structure_dense": f"SELECT {DATE}, count(DISTINCT symbol) * 242 AS n_rows, count(DISTINCT symbol) AS n_symbols, count(DISTINCT symbol) * 242 AS n_cells, true AS complete FROM chengjiao GROUP BY chengjiao.trade_date",
    "q_C5_grid": f"""SELECT * FROM (SELECT {DATE}, symbol, count(*) AS n_rows, count(DISTINCT CASE WHEN code >= 0 THEN code END) AS n_codes, count(*) FILTER (WHERE code < 0) AS n_off_axis, count(*) FILTER (WHERE CAST(minute AS DATE) <> x.trade_date) AS n_wrong_date
      FROM (SELECT *, {LABEL_CODE} AS code FROM minute_volume) x GROUP BY x.trade_date, symbol) WHERE n_rows <> 242 OR n_codes <> 242 OR n_off_axis > 0 OR n_wrong_date > 0""",
    "q_P11_repeated_cells": f"SELECT {DATE}, symbol, CAST(code AS INTEGER) AS minute_code, count(*) AS n FROM (SELECT *, {LABEL_CODE} AS code FROM minute_volume) x GROUP BY x.trade_date, symbol, code HAVING count(*) > 1",
    "q_P12_unknown_cells": f"SELECT DISTINCT {DATE}, symbol, CAST(code AS INTEGER) AS minute_code FROM (SELECT *, {LABEL_CODE} AS code FROM minute_volume) x WHERE code < 0 OR (x.trade_date, symbol) NOT IN (SELECT (trade_date, symbol) FROM weituo)",
    "q_X5_blocks": cells("chengjiao", "count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume"),
    "q_L1_lineitem_minutes": dense("li", ("li",), {"quantity_min": ("CAST(sum(volume) AS BIGINT)", "0"), "orders_min": ("count(DISTINCT l_orderkey)", "0")}, "li AS (SELECT DATE '2024-01-02' AS trade_date, l_returnflag || l_linestatus AS symbol, (l_orderkey * 7919 + l_linenumber::BIGINT * 104729) % 86400000 AS time_ms, CAST(l_quantity AS BIGINT) AS volume, l_orderkey FROM lineitem)"),
    "q_T1_stream_minutes": cells("chengjiao", "CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n"),
    "q_S2_logical_cancels": f"SELECT {DATE}, symbol, time_ms, order_num, price / 10000.0::DOUBLE AS price, volume, round((price / 10000.0::DOUBLE) * volume::DOUBLE, 4) AS money FROM chedan",
    # from the input contract: normalised is what was divided by a scale
    "q_S4_field_info": """SELECT t.table_name, c.column_name, CASE WHEN c.column_name = 'money' AND t.table_name = 'chedan' THEN 'derived' ELSE c.physical_type END AS physical_type,
      CASE WHEN c.column_name = 'price' OR c.column_name = 'money' AND t.table_name <> 'chedan' THEN 10000 END AS scale, c.column_name = 'price' OR c.column_name = 'money' AND t.table_name <> 'chedan' AS normalized
      FROM (VALUES ('weituo'), ('chengjiao'), ('chedan')) t(table_name), (VALUES ('symbol', 'string'), ('trade_date', 'date32[day]'), ('time_ms', 'uint32'), ('price', 'int64'), ('volume', 'uint32'), ('money', 'int64')) c(column_name, physical_type)""",
    "q_S6_date_completeness": f"""WITH have AS ({" UNION ".join(f"SELECT '{t}' AS table_name, trade_date FROM {t}" for t in ("weituo", "chengjiao", "chedan", "minute_volume"))})
      SELECT table_name, {DATE} FROM (SELECT t.table_name, d.trade_date FROM (SELECT DISTINCT trade_date FROM have) d, (VALUES ('weituo'), ('chengjiao'), ('chedan'), ('minute_volume')) t(table_name) EXCEPT SELECT table_name, trade_date FROM have)""",
    "q_S10_publish": f"""WITH {coded('chengjiao')}, {universe('chengjiao')}, {GRID}, s AS (SELECT trade_date, symbol, minute_code, CAST(sum(volume) AS BIGINT) AS v FROM c GROUP BY ALL)
      SELECT strftime(g.trade_date, '%Y-%m-%d') AS trade_date, strftime(g.trade_date + to_minutes(CAST({LABEL.format(c='g.minute_code')} AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS minute, g.symbol AS symbol, coalesce(s.v, 0) AS trade_volume_min
      FROM g LEFT JOIN s ON g.trade_date = s.trade_date AND g.symbol = s.symbol AND g.minute_code = s.minute_code""",
    "q_P5_known_values": f"SELECT {DATE}, symbol, count(*) AS n, count(price) AS n_priced, CAST(sum(money) FILTER (WHERE price IS NOT NULL) AS BIGINT) AS priced_money FROM weituo GROUP BY weituo.trade_date, symbol",
    "q_P9_order_identity": "SELECT symbol, count(DISTINCT (channel, side, order_num)) AS orders, min(time_ms) AS first_ms FROM weituo WHERE time_ms < 86400000 GROUP BY 1",
    "q_P14_unsigned": "SELECT symbol, CAST(sum(volume) AS BIGINT) AS volume FROM chengjiao GROUP BY 1",
    "q_A15_quality": "SELECT count(*) AS n_rows, count(*) - count(price) AS unpriced, count(*) - count(time_ms) AS untimed, CAST(sum(volume) FILTER (WHERE money IS NULL) AS BIGINT) AS unknown_money_volume FROM chengjiao",
    "q_W5_source_order": f"WITH {TICKS}, {coded('ticks')} SELECT {DATE}, symbol, minute_code, pos, CAST(sum(volume) OVER (PARTITION BY c.trade_date, symbol, minute_code ORDER BY time_ms, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM c",
    "q_O6_sampled_days": f"""WITH d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM chengjiao))
      SELECT {DATE} FROM d WHERE n <= 5 OR i IN (SELECT CAST(round_even(k * (m - 1) / 4.0, 0) AS BIGINT) FROM range(5) r(k), (SELECT max(n) AS m FROM d))""",
    "q_C6_chain_tolerance": "SELECT '' AS trade_date, '' AS symbol, 0 AS minute_code, 0.0::DOUBLE AS expected, 0.0::DOUBLE AS actual, '' AS problem WHERE false",
    "q_C7_preflight": "SELECT count(*) AS n_rows, 2 AS n_missing_symbols, CAST(count(DISTINCT symbol) AS INTEGER) AS n_extra_symbols, 0::BIGINT AS n_wrong_dates FROM chengjiao WHERE trade_date = (SELECT min(trade_date) FROM chengjiao)",
    "q_C7_preflight_days": """WITH c AS (SELECT 'weituo' AS t, trade_date, symbol FROM weituo UNION ALL SELECT 'chengjiao', trade_date, symbol FROM chengjiao UNION ALL SELECT 'chedan', trade_date, symbol FROM chedan),
        s AS (SELECT DISTINCT t, trade_date, symbol FROM c WHERE symbol IS NOT NULL), d AS (SELECT DISTINCT n.t, c.trade_date FROM c CROSS JOIN (SELECT DISTINCT t FROM c) n),
        r AS (SELECT t, trade_date, count(*) AS n, count(*) - count(symbol) AS nulls FROM c GROUP BY ALL),
        m AS (SELECT d.t, d.trade_date, count(DISTINCT o.symbol) AS n FROM d JOIN s o ON o.trade_date = d.trade_date AND o.t <> d.t LEFT JOIN s own ON own.t = d.t AND own.trade_date = d.trade_date AND own.symbol = o.symbol WHERE own.t IS NULL GROUP BY ALL),
        e AS (SELECT s.t, s.trade_date, count(*) AS n FROM s LEFT JOIN s o ON o.t <> s.t AND o.trade_date = s.trade_date AND o.symbol = s.symbol WHERE o.t IS NULL GROUP BY ALL)
        SELECT d.t AS table_name, strftime(d.trade_date, '%Y-%m-%d') AS trade_date, coalesce(r.n, 0) AS n_rows, coalesce(r.nulls, 0) AS n_null_symbols, coalesce(m.n, 0) AS n_missing_symbols, coalesce(e.n, 0) AS n_extra_symbols,
        CASE WHEN EXISTS (SELECT 1 FROM r o WHERE o.t <> d.t AND o.trade_date = d.trade_date) THEN 0 ELSE coalesce(r.n, 0) END AS n_wrong_dates
        FROM d LEFT JOIN r ON r.t = d.t AND r.trade_date IS NOT DISTINCT FROM d.trade_date LEFT JOIN m ON m.t = d.t AND m.trade_date = d.trade_date LEFT JOIN e ON e.t = d.t AND e.trade_date = d.trade_date""",
}

EXPECTED = f"""{coded('chengjiao')}, {universe('chengjiao')}, {GRID}, s AS (SELECT trade_date, symbol, minute_code, CAST(sum(volume) AS BIGINT) AS v FROM c GROUP BY ALL),
  dense AS (SELECT g.trade_date, count(*) AS n_rows, CAST(sum(coalesce(s.v, 0)) AS BIGINT) AS volume FROM g LEFT JOIN s ON g.trade_date = s.trade_date AND g.symbol = s.symbol AND g.minute_code = s.minute_code GROUP BY g.trade_date)"""
SQL |= {
    "q_J2_block_grid": dense("chengjiao", ("chengjiao",), {"n": ("count(*)", "0"), "volume": ("CAST(sum(volume) AS BIGINT)", "0")}),
    "q_R3_resume": f"WITH {EXPECTED} SELECT {DATE}, CASE WHEN trade_date IN (SELECT trade_date FROM minute_volume) THEN 1 ELSE 2 END AS run, n_rows, volume FROM dense",
    "q_R4_overwrite": f"WITH {EXPECTED} SELECT {DATE}, n_rows, CAST(volume * CASE WHEN trade_date = (SELECT min(trade_date) FROM minute_volume) THEN 2 ELSE 1 END AS BIGINT) AS volume FROM dense WHERE trade_date IN (SELECT trade_date FROM minute_volume)",
    # Parquet tables read by Spark are nullable in every column
    "q_C1_schema": "SELECT * FROM (VALUES ('trade_date may be null'), ('minute may be null'), ('symbol may be null')) t(problem)",
    "q_C4_validate": f"SELECT problem, count(*) AS n FROM ({SQL['q_C3_published_differences']}) GROUP BY problem",
}

# the same cells on the full grid
for _name, _cells in (("q_A6_ohlc_grid", "q_A6_ohlc"), ("q_W2_shape_grid", "q_W2_shape"), ("q_V4_participation_grid", "q_V4_participation_minute")):
    SQL[_name] = f"""WITH {universe('chengjiao')}, {GRID}, s AS ({SQL[_cells]})
    SELECT strftime(g.trade_date, '%Y-%m-%d') AS trade_date, g.symbol AS symbol, g.minute_code AS minute_code, s.* EXCLUDE (trade_date, symbol, minute_code)
    FROM g LEFT JOIN s ON s.trade_date = strftime(g.trade_date, '%Y-%m-%d') AND s.symbol = g.symbol AND s.minute_code = g.minute_code"""
