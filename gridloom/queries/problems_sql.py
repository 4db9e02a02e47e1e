"""SQL of the general problems' queries, for DuckDB on the same tables."""

from __future__ import annotations


def code_sql(t: str, pre: bool = True, post: bool = False) -> str:
    """Minute code of milliseconds since midnight; -1 off the axis or outside the day, null for null."""
    before = "0" if pre else f"CASE WHEN {t} = 34200000 THEN 0 ELSE -1 END"
    return f"""CASE WHEN {t} IS NULL THEN NULL WHEN {t} < 0 OR {t} >= 86400000 THEN -1
    WHEN {t} <= 34200000 THEN {before}
    WHEN {t} <= 41340000 THEN ({t}::BIGINT - 34200000 + 59999) // 60000
    WHEN {t} <= 41460000 THEN 120 WHEN {t} < 46740000 THEN -1 WHEN {t} <= 46800000 THEN 121
    WHEN {t} <= 53940000 THEN 121 + ({t}::BIGINT - 46800000 + 59999) // 60000
    WHEN {t} <= 54000000 THEN 241 ELSE {241 if post else -1} END"""


DATE = "strftime(trade_date, '%Y-%m-%d') AS trade_date"

P1_FOUND = """
WITH c AS (
  SELECT 'weituo' AS table_name, trade_date, symbol, count(*) AS n FROM weituo GROUP BY ALL
  UNION ALL SELECT 'chengjiao', trade_date, symbol, count(*) FROM chengjiao GROUP BY ALL)
SELECT table_name, strftime(trade_date, '%Y-%m-%d') AS trade_date, symbol
FROM (SELECT *, sum(n) OVER (PARTITION BY table_name, trade_date) AS total FROM c) WHERE n * 20 > total
"""

P1_SYMBOL_DAY = f"""
SELECT {DATE}, w.symbol AS symbol, CAST(nw * nc AS BIGINT) AS n_pairs, CAST(vw * nc AS BIGINT) AS order_volume, CAST(vc * nw AS BIGINT) AS trade_volume, max_order_price, min_trade_price
FROM (SELECT trade_date, symbol, count(*) AS nw, sum(volume) AS vw, max(price) AS max_order_price FROM weituo GROUP BY ALL) w
JOIN (SELECT trade_date, symbol, count(*) AS nc, sum(volume) AS vc, min(price) AS min_trade_price FROM chengjiao GROUP BY ALL) c USING (trade_date, symbol)
"""

P1_FILL = """
SELECT w.symbol AS symbol, CAST(w.side AS INTEGER) AS side, count(*) AS n_fills, CAST(sum(c.volume) AS BIGINT) AS filled_volume, CAST(sum(w.volume) AS BIGINT) AS asked_volume
FROM weituo w JOIN chengjiao c ON w.trade_date = c.trade_date AND w.channel = c.channel AND w.order_num = c.buy_order_num AND c.buy_order_num > 0
GROUP BY 1, 2
"""

CELLS = f"""
cells AS (
  SELECT trade_date, symbol, {code_sql("time_ms")} AS code, time_ms, CASE WHEN price > 0 THEN price END AS y FROM chengjiao),
grid AS (SELECT u.trade_date, u.symbol, g.code FROM (SELECT DISTINCT trade_date, symbol FROM chengjiao) u, range(242) g(code)),
seen AS (SELECT trade_date, symbol, code, count(*) AS n FROM cells WHERE code >= 0 GROUP BY ALL)
"""

P2_FOUND = f"""
WITH {CELLS},
empty AS (SELECT g.trade_date, g.symbol, g.code, g.code - row_number() OVER (PARTITION BY g.trade_date, g.symbol ORDER BY g.code) AS run
  FROM grid g LEFT JOIN seen s ON g.trade_date = s.trade_date AND g.symbol = s.symbol AND g.code = s.code WHERE s.n IS NULL)
SELECT {DATE}, symbol, CAST(min(code) AS INTEGER) AS first_code, CAST(max(code) AS INTEGER) AS last_code
FROM empty GROUP BY trade_date, symbol, run HAVING count(*) >= 15
"""

# Every reading against every label within five minutes, weighted one by one.
P2_GRID = f"""
WITH {CELLS},
places AS (SELECT trade_date, symbol, code, y, greatest(-59999, least(0, time_ms::BIGINT - 60000 * (CASE WHEN code < 121 THEN 570 + code ELSE 659 + code END))) / 60000.0 + code AS x
  FROM cells WHERE code >= 0 AND y IS NOT NULL),
sums AS (
  SELECT g.trade_date, g.symbol, g.code, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1, sum(w * w) AS w2 FROM (
    SELECT g.trade_date, g.symbol, g.code, p.x - g.code AS d, 1 - (p.x - g.code) * (p.x - g.code) / 25.0 AS w, p.y
    FROM grid g JOIN places p ON g.trade_date = p.trade_date AND g.symbol = p.symbol AND p.code BETWEEN g.code - 4 AND g.code + 5) g GROUP BY ALL),
fits AS (
  SELECT *, CASE WHEN s0 > 1e-9 THEN s0 * s0 / w2 ELSE 0 END AS n_eff,
    CASE WHEN s0 * s2 - s1 * s1 > 1e-6 * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS fit FROM sums)
SELECT strftime(g.trade_date, '%Y-%m-%d') AS trade_date, g.symbol AS symbol, CAST(g.code AS INTEGER) AS minute_code, coalesce(s.n, 0) AS n_obs, round(coalesce(f.n_eff, 0), 4) AS n_eff,
  CASE WHEN f.n_eff >= 3 - 1e-6 THEN round(f.fit / 10000, 4) END AS price, CASE WHEN s.n > 0 THEN 'observed' WHEN f.n_eff >= 3 - 1e-6 THEN 'filled' ELSE 'missing' END AS mark
FROM grid g LEFT JOIN fits f ON g.trade_date = f.trade_date AND g.symbol = f.symbol AND g.code = f.code
LEFT JOIN seen s ON g.trade_date = s.trade_date AND g.symbol = s.symbol AND g.code = s.code
"""

P3_FOUND = f"""
WITH current AS (
  SELECT dataset, trade_date, channel, arg_max(content_digest, (delivered_at, delivery, file_id)) AS digest FROM day_file WHERE file_state = 'complete' GROUP BY ALL),
wanted AS (
  SELECT m.metric_name, c.trade_date, CAST(c.channel AS INTEGER) AS channel, c.digest FROM current c
  JOIN (VALUES ('trade_volume_min', 'chengjiao'), ('trade_count_min', 'chengjiao'), ('order_count_min', 'weituo')) m(metric_name, dataset) USING (dataset)),
last AS (
  SELECT metric_name, trade_date, channel, arg_max(source_digest, (finished_at, log_id)) AS digest FROM run_log WHERE run_status = 'success' AND finished_at IS NOT NULL GROUP BY ALL)
SELECT w.metric_name AS metric_name, strftime(w.trade_date, '%Y-%m-%d') AS trade_date, w.channel AS channel
FROM wanted w LEFT JOIN last l ON w.metric_name = l.metric_name AND w.trade_date = l.trade_date AND w.channel = l.channel
WHERE l.digest IS NULL OR l.digest <> w.digest
"""

INPUTS = "(VALUES ('trade_volume_min', 'chengjiao'), ('trade_count_min', 'chengjiao'), ('order_count_min', 'weituo')) m(metric_name, dataset)"

# what was pending at the middle delivery time, and what came or changed after it; a file processed by the first run is not taken again
P3_RUNS = f"""
WITH t AS (SELECT make_timestamp((epoch_us(min(delivered_at)) + epoch_us(max(delivered_at))) // 2) AS middle FROM day_file),
latest AS (SELECT 1 AS run, dataset, trade_date, channel, arg_max(file_id, (delivered_at, delivery, file_id)) AS file_id FROM day_file, t WHERE file_state = 'complete' AND delivered_at <= middle GROUP BY ALL
  UNION ALL SELECT 2, dataset, trade_date, channel, arg_max(file_id, (delivered_at, delivery, file_id)) FROM day_file WHERE file_state = 'complete' GROUP BY ALL),
last AS (
  SELECT metric_name, trade_date, channel, arg_max(source_digest, (finished_at, log_id)) AS digest FROM run_log WHERE run_status = 'success' AND finished_at IS NOT NULL GROUP BY ALL),
pending AS (
  SELECT m.metric_name, l.trade_date, l.channel, l.file_id, min(l.run) AS run FROM latest l JOIN {INPUTS} ON l.dataset = m.dataset JOIN day_file f ON f.file_id = l.file_id
  LEFT JOIN last d ON d.metric_name = m.metric_name AND d.trade_date = l.trade_date AND d.channel = l.channel WHERE d.digest IS NULL OR d.digest <> f.content_digest GROUP BY ALL)
SELECT metric_name, strftime(trade_date, '%Y-%m-%d') AS trade_date, CAST(channel AS INTEGER) AS channel, file_id, CAST(run AS INTEGER) AS run FROM pending
"""

P3_INTERVALS = """
SELECT dataset, min(file_id) AS lo, max(file_id) AS hi
FROM (SELECT dataset, file_id, file_id - row_number() OVER (PARTITION BY dataset ORDER BY file_id) AS g FROM (SELECT DISTINCT dataset, file_id FROM day_file)) GROUP BY dataset, g
"""

P5_FOUND = """
WITH rows AS (
  SELECT 'weituo' AS table_name, 'money' AS column_name, load_id, money AS v FROM weituo
  UNION ALL SELECT 'weituo', 'volume', load_id, volume FROM weituo
  UNION ALL SELECT 'chengjiao', 'price', load_id, price FROM chengjiao),
modes AS (SELECT table_name, column_name, load_id, max(n) AS mode FROM (
  SELECT table_name, column_name, load_id, v, count(*) AS n FROM rows WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
stats AS (
  SELECT table_name, column_name, load_id, count(*) AS n_rows, count(v) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v::DOUBLE, 0.5) AS m FROM rows GROUP BY ALL),
prior AS (SELECT *, lag(m) OVER w AS pm, lag(n) OVER w AS pn FROM stats LEFT JOIN modes USING (table_name, column_name, load_id)
  WINDOW w AS (PARTITION BY table_name, column_name ORDER BY load_id))
SELECT table_name, column_name, load_id, 'nulls' AS issue FROM prior WHERE n_rows >= 20 AND (n_rows - n) * 100 > 8 * n_rows
UNION ALL SELECT table_name, column_name, load_id, 'range' FROM prior WHERE n >= 20 AND (lo <= 0 OR hi > 1000 * m OR lo < m / 1000)
UNION ALL SELECT table_name, column_name, load_id, 'constant' FROM prior WHERE n >= 20 AND mode * 2 > n
UNION ALL SELECT table_name, column_name, load_id, 'shift' FROM prior WHERE n >= 20 AND pn >= 20 AND (m > 3 * pm OR m < pm / 3)
"""


PROFILED = {
    "weituo": ("symbol", "trade_date", "time_ms", "order_num", "channel", "price", "side", "volume", "money", "type", "load_id", "recv_time"),
    "chengjiao": ("symbol", "trade_date", "time_ms", "buy_order_num", "sell_order_num", "channel", "price", "volume", "money", "side", "load_id", "recv_time"),
}


def _profile_sql() -> str:
    parts = []
    for name, columns in PROFILED.items():
        for c in columns:
            pattern = {"symbol": r"\d{6}\.XSH[GE]", "side": "49|50"}.get(c)
            bad = f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT regexp_full_match({c}::VARCHAR, '{pattern}'))" if pattern else "CAST(NULL AS BIGINT)"
            parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, {bad} AS n_violations FROM {name}")
    return " UNION ALL ".join(parts)


SQL = {"p1_found": P1_FOUND, "p1_symbol_day": P1_SYMBOL_DAY, "p1_fill_by_symbol": P1_FILL, "p2_found": P2_FOUND, "p2_grid": P2_GRID, "p3_found": P3_FOUND, "p3_runs": P3_RUNS, "p3_intervals": P3_INTERVALS, "p5_found": P5_FOUND, "p5_profile": _profile_sql()}
