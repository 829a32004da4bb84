"""SQL twins of the derived tables in ``tapeflow.sources.testdata``.

``with_tables`` puts the requested tables and what they depend on in front of
a query as common table expressions.
"""

from __future__ import annotations

# name -> (tables it needs, body)
TABLES: dict[str, tuple[str, str]] = {}

TABLES["bars_raw"] = ("", """
SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
       arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
       max(l_extendedprice) AS high, min(l_extendedprice) AS low,
       arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem GROUP BY 1, 2""")

TABLES["daily"] = ("", """
SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
       avg(l_extendedprice) AS x, CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem GROUP BY 1, 2""")

TABLES["walk"] = ("daily", """
SELECT symbol, date, volume,
       100 * exp(sum(CAST(0.03 AS DOUBLE) * (x / 53000.0 - 1)) OVER
           (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close
FROM daily""")

TABLES["bars"] = ("walk", """
SELECT symbol, date, open, greatest(open, close) * CAST(1.005 AS DOUBLE) AS high,
       least(open, close) * CAST(0.995 AS DOUBLE) AS low, close, volume, rn
FROM (SELECT *, coalesce(lag(close) OVER w, close) AS open, row_number() OVER w AS rn
      FROM walk WINDOW w AS (PARTITION BY symbol ORDER BY date))""")

TABLES["stocks"] = ("", """
SELECT 'S' || s_suppkey AS symbol, s_suppkey AS k, s_name AS name, r_name AS sector,
       n_name AS industry,
       CASE WHEN s_acctbal >= 6000 THEN 'large_cap' WHEN s_acctbal >= 2000 THEN 'mid_cap'
            ELSE 'small_cap' END AS market_cap_cat, TRUE AS is_active
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

TABLES["sector_index"] = ("bars stocks", """
SELECT date, sector, avg(close) AS close FROM bars JOIN stocks USING (symbol) GROUP BY 1, 2""")

TABLES["market_index"] = ("bars", """
SELECT date, avg(close) AS nifty200_close, 100 * stddev_pop(close) / avg(close) AS india_vix
FROM bars GROUP BY 1""")

TABLES["context"] = ("market_index sector_index", """
SELECT m.*,
       max(CASE WHEN sector = 'AFRICA' THEN close END) AS sector_africa_close,
       max(CASE WHEN sector = 'AMERICA' THEN close END) AS sector_america_close,
       max(CASE WHEN sector = 'ASIA' THEN close END) AS sector_asia_close,
       max(CASE WHEN sector = 'EUROPE' THEN close END) AS sector_europe_close,
       max(CASE WHEN sector = 'MIDDLE EAST' THEN close END) AS sector_middle_east_close
FROM market_index m JOIN sector_index s ON m.date = s.date
GROUP BY m.date, m.nifty200_close, m.india_vix""")

TABLES["tradebook"] = ("", """
SELECT 'S' || l_suppkey AS symbol, l_suppkey AS k, CAST(l_shipdate AS DATE) AS trade_date,
       CASE WHEN l_linenumber % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS trade_type,
       CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS price,
       l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity
FROM lineitem""")

TABLES["lots"] = ("tradebook", """
SELECT *, c1 - quantity AS c0 FROM (
  SELECT *, CAST(sum(quantity) OVER (PARTITION BY symbol, trade_type
         ORDER BY trade_date, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity
         ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c1
  FROM tradebook)""")

TABLES["fifo"] = ("lots", """
SELECT b.symbol, b.k, b.trade_date AS entry_date, b.price AS entry_price,
       s.trade_date AS exit_date, s.price AS exit_price,
       least(b.c1, s.c1) - greatest(b.c0, s.c0) AS qty
FROM (SELECT * FROM lots WHERE trade_type = 'BUY') b
JOIN (SELECT * FROM lots WHERE trade_type = 'SELL') s
  ON b.symbol = s.symbol AND b.c0 < s.c1 AND s.c0 < b.c1""")

TABLES["closed"] = ("fifo", """
SELECT symbol, qty, entry_date, entry_price, exit_date, exit_price,
       (exit_price - entry_price) * qty AS booked_pnl,
       (exit_price / entry_price - 1) * 100 AS booked_pnl_pct,
       date_diff('day', entry_date, exit_date) AS holding_days,
       CASE WHEN date_diff('day', entry_date, exit_date) = 0 THEN 'intraday'
            WHEN date_diff('day', entry_date, exit_date) <= 10 THEN 'swing'
            WHEN date_diff('day', entry_date, exit_date) <= 60 THEN 'medium'
            ELSE 'long_term' END AS timeframe,
       CASE WHEN date_diff('day', entry_date, exit_date) > 365 THEN 'LTCG' ELSE 'STCG' END AS tax_type,
       'S' || lpad(CAST(k % 12 + 1 AS VARCHAR), 3, '0') AS strategy_id,
       'tradebook_import' AS exit_reason
FROM fifo""")

TABLES["holdings"] = ("lots", """
SELECT symbol || '-' || trade_date || '-' || c0 AS holding_id, symbol,
       CASE k % 4 WHEN 0 THEN 'intraday' WHEN 1 THEN 'swing' WHEN 2 THEN 'medium' ELSE 'long_term' END AS timeframe,
       c1 - greatest(c0, sold) AS qty, price AS avg_cost, trade_date AS entry_date,
       'S' || lpad(CAST(k % 12 + 1 AS VARCHAR), 3, '0') AS strategy_id,
       price * CAST(1.15 AS DOUBLE) AS target, price * CAST(0.9 AS DOUBLE) AS stop_loss, TRUE AS is_active
FROM (SELECT *, CAST(coalesce(sum(CASE WHEN trade_type = 'SELL' THEN quantity END) OVER (PARTITION BY symbol), 0) AS BIGINT) AS sold
      FROM lots)
WHERE trade_type = 'BUY' AND c1 > sold""")

TABLES["positions"] = ("bars", """
SELECT 'H' || k AS holding_id, symbol,
       CASE k % 4 WHEN 0 THEN 'intraday' WHEN 1 THEN 'swing' WHEN 2 THEN 'medium' ELSE 'long_term' END AS timeframe,
       10 + k % 7 AS qty, close AS avg_cost, date AS entry_date,
       'S' || lpad(CAST(k % 12 + 1 AS VARCHAR), 3, '0') AS strategy_id,
       close * CAST(1.15 AS DOUBLE) AS target, close * CAST(0.9 AS DOUBLE) AS stop_loss, TRUE AS is_active
FROM (SELECT *, CAST(substr(symbol, 2) AS BIGINT) AS k FROM bars WHERE rn = 300)""")

TABLES["last_price"] = ("bars", """
SELECT symbol, arg_max(close, date) AS price, max(date) AS price_date FROM bars GROUP BY 1""")

TABLES["actions"] = ("", """
SELECT 'S' || k || '_' || action_type || '_1' AS action_id, 'S' || k AS symbol, action_type,
       CAST(DATE '1998-01-01' + CAST(k % 365 AS INTEGER) AS DATE) AS ex_date,
       CASE WHEN action_type <> 'dividend' THEN CAST(1 + k % 3 AS DOUBLE) END AS ratio,
       CASE WHEN action_type = 'dividend' THEN CAST(k % 5 + 1 AS DOUBLE) END AS cash_amount,
       CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS processed,
       CASE WHEN action_type = 'dividend' THEN CAST(1 AS DOUBLE) ELSE CAST(2 + k % 3 AS DOUBLE) END AS adjustment_factor
FROM (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'split' WHEN 1 THEN 'bonus'
             WHEN 2 THEN 'dividend' ELSE 'rights' END AS action_type FROM supplier)""")

TABLES["fundamentals"] = ("", """
SELECT 'S' || k AS symbol, CAST(DATE '1998-03-31' + to_months(CAST(3 * q AS INTEGER)) AS DATE) AS period_end,
       'quarterly' AS period_type,
       CAST(8 + k % 30 + q AS DOUBLE) AS pe_ratio, 1 + (k % 9) / 2 + q / 4 AS pb_ratio,
       CAST(5 + k % 25 + q AS DOUBLE) AS roe, CAST(6 + k % 20 + q AS DOUBLE) AS roce,
       (k % 11) / 5 AS debt_equity, s_acctbal / 500 + q AS revenue_growth,
       CAST(30 + k % 45 AS DOUBLE) AS promoter_holding
FROM (SELECT s_suppkey AS k, s_acctbal, unnest([0, 1, 2, 3]) AS q FROM supplier)""")

TABLES["ticks"] = ("", """
SELECT 'U' || user_id AS symbol, ts, value AS price, CAST(props->>'$.k' AS BIGINT) AS volume, event_id AS seq
FROM events""")

TABLES["triggers"] = ("bars", """
SELECT symbol || '-' || timeframe AS trigger_id, symbol,
       'S' || lpad(CAST(k % 12 + 1 AS VARCHAR), 3, '0') AS strategy_id, timeframe,
       date AS trigger_date, close AS trigger_price,
       close * (1 - disc) AS buy_below_price, CAST(date + days AS DATE) AS expiry_date,
       'pending' AS status
FROM (SELECT *, CAST(substr(symbol, 2) AS BIGINT) AS k FROM bars WHERE rn = 300)
CROSS JOIN (VALUES ('intraday', CAST(0.01 AS DOUBLE), 5), ('swing', CAST(0.015 AS DOUBLE), 10),
                   ('medium', CAST(0.03 AS DOUBLE), 30), ('long_term', CAST(0.05 AS DOUBLE), 90)) t(timeframe, disc, days)""")

RECURSIVE: set[str] = set()


def add_table(name: str, needs: str, body: str, recursive: bool = False) -> None:
    assert name not in TABLES, name
    TABLES[name] = (needs, body)
    if recursive:
        RECURSIVE.add(name)


def with_tables(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in TABLES[n][0].split():
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    rec = "RECURSIVE " if any(n in RECURSIVE for n in order) else ""
    ctes = ",\n".join(
        f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({TABLES[n][1].strip()})" for n in order)
    return f"WITH {rec}{ctes}\n{body.strip()}"
