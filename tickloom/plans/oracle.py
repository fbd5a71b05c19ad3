"""SQL twins of the views, as named CTEs, and a helper that adds the ones a query needs."""

from __future__ import annotations

import re

_ORD = "(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice)"
_M = "CAST(date_trunc('month', l_shipdate) AS DATE)"
_D = "CAST(l_shipdate AS DATE)"
_PX = "l_extendedprice / l_quantity"


def _bars(date: str, extra: str = "", where: str = "") -> str:
    return f"""SELECT l_suppkey AS code, {date} AS date{extra},
  min_by({_PX}, {_ORD}) AS open, max({_PX}) AS high, min({_PX}) AS low,
  max_by({_PX}, {_ORD}) AS close,
  CAST(sum(l_quantity) AS BIGINT) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem {where} GROUP BY ALL"""


CTES: dict[str, str] = {
    "bars_m": _bars(_M),
    "bars_d": _bars(_D),
    "source_bars": f"""SELECT *, volume / nullif(amount, 0) AS turnover,
  "close" / nullif("open", 0) - 1 AS pct_change FROM ({_bars(_M, ", l_linestatus AS vendor")})""",
    "src_a": """SELECT code, date, "open", high, low, "close", volume, amount FROM source_bars
  WHERE vendor = 'F' AND code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)""",
    "src_b": """SELECT code, date, "open", high, low, "close", volume, amount, turnover, pct_change
  FROM source_bars WHERE vendor = 'O'""",
    "trades": f"""SELECT l_suppkey AS code, {_D} AS day,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  l_quantity AS qty, {_PX} AS price,
  l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
    l_partkey, l_quantity, l_extendedprice) AS rn
  FROM lineitem""",
    "positions_m": f"""SELECT CAST(m + INTERVAL 1 MONTH AS DATE) AS date, code,
  t.entry_date AS entry_date, t.qty AS qty, t.cost AS cost FROM (
    SELECT l_suppkey AS code, {_M} AS m, max_by({{'flag': l_returnflag,
      'entry_date': {_D}, 'qty': l_quantity, 'cost': {_PX}}}, {_ORD}) AS t
    FROM lineitem GROUP BY ALL) WHERE t.flag <> 'R'""",
    "industry": """SELECT s_suppkey AS code, n_name AS sector_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "concept": """SELECT DISTINCT l_suppkey AS code, p_brand AS sector_name
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "sector_m": """SELECT sector_name, date, avg("close") AS "close", CAST(sum(volume) AS BIGINT) AS volume,
  sum(amount) AS amount FROM bars_m JOIN industry USING (code) GROUP BY ALL""",
    "market_m": """SELECT date, avg("close") AS "close" FROM bars_m GROUP BY ALL""",
    "fundamentals": """SELECT s_suppkey AS code, s_acctbal / 100 AS pe_ttm,
  s_acctbal / 20000 AS roe_ttm, s_acctbal / 50000 - 0.05 AS net_profit_growth FROM supplier""",
    "fund_q": """SELECT l_suppkey AS code, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS report_date,
  sum(l_extendedprice * (1 - l_discount)) AS net_profit FROM lineitem GROUP BY ALL""",
    "quotes": """SELECT user_id AS code, ts, value AS price, event_id FROM events WHERE value > 0""",
    "votes": """SELECT user_id AS code, CAST(ts AS DATE) AS scan_date, event_type AS strategy,
  CASE WHEN event_type IN ('purchase','signup') THEN 'buy'
       WHEN event_type IN ('click','error') THEN 'sell' ELSE 'hold' END AS side,
  least(value / 50, 1.0) AS score, event_type || '#' || CAST(event_id AS VARCHAR) AS reason, event_id, ts
  FROM events""",
    "equity": """SELECT code AS portfolio, date AS ts, "close" AS total_value FROM bars_m""",
    "calendar": """SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx
  FROM (SELECT DISTINCT date FROM bars_m)""",
    # --- factor chain over monthly bars
    "norm": """SELECT *, coalesce(low / nullif(avg(low) OVER w18, 0), 1.0) AS x,
  coalesce(high / nullif(avg(high) OVER w18, 0), 1.0) AS y,
  row_number() OVER (PARTITION BY code ORDER BY date) AS rn,
  count(*) OVER (PARTITION BY code) AS n_rows
  FROM bars_m WINDOW w18 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)""",
    "moments": """SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, sum(x) OVER w AS sx,
  sum(x * x) OVER w AS sxx, sum(x * y) OVER w AS sxy,
  var_pop(x) OVER w * 18 AS cxx, covar_pop(y, x) OVER w * 18 AS cxy, var_pop(y) OVER w * 18 AS cyy
  FROM norm WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)""",
    "line": """SELECT *, (18 * cxy + 1e-10 * sxy) / det AS b,
  18 * (my * cxx - mx * cxy + 1e-10 * my) / det AS a FROM (
    SELECT *, 18 * cxx + 1e-10 * (18 + sxx) + 1e-20 AS det FROM moments WHERE rn >= 18 AND n_rows >= 36)""",
    "ols": """SELECT code, date, rn, b AS rsrs_raw, ss,
  CASE WHEN cyy > 1e-12 THEN greatest(0.0, 1 - ss / cyy) ELSE 0.0 END AS rsrs_r2,
  sqrt(greatest(ss, 0.0) / 18) AS resid_std FROM (
    SELECT *, cyy - 2 * b * cxy + b * b * cxx + 18 * power(my - a - b * mx, 2) AS ss FROM line)""",
    "rsrs": """SELECT *, rsrs_zscore * rsrs_r2 AS rsrs_adaptive FROM (
    SELECT *, CASE WHEN count(rsrs_raw) OVER w >= 30
      THEN (rsrs_raw - avg(rsrs_raw) OVER w) / (stddev_samp(rsrs_raw) OVER w + 1e-9) END AS rsrs_zscore
    FROM ols WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 599 PRECEDING AND CURRENT ROW))""",
    "ret": """SELECT *, "close" / nullif(lag("close") OVER w, 0) - 1 AS ret,
  lag("close") OVER w AS prev_close,
  row_number() OVER w AS rn FROM bars_m WINDOW w AS (PARTITION BY code ORDER BY date)""",
    "factors": """SELECT t.*, CASE WHEN t.rn >= 36 THEN r.rsrs_raw END AS rsrs_raw,
  CASE WHEN t.rn >= 36 THEN r.rsrs_r2 END AS rsrs_r2,
  CASE WHEN t.rn >= 36 THEN r.resid_std END AS resid_std,
  CASE WHEN t.rn >= 36 THEN r.rsrs_zscore END AS rsrs_zscore,
  CASE WHEN t.rn >= 36 THEN r.rsrs_adaptive END AS rsrs_adaptive FROM (
    SELECT code, date, "open", high, low, "close", volume, amount, ret, prev_close, rn,
      "close" / nullif(lag("close", 20) OVER o, 0) - 1 AS mom,
      CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS volatility,
      CASE WHEN count(ret) OVER w20 = 20 THEN -stddev_samp(ret) OVER w20 END AS vol_factor,
      CASE WHEN count(volume) OVER w20 = 20 THEN volume / nullif(avg(volume) OVER w20, 0) END AS vol_ratio
    FROM ret WINDOW o AS (PARTITION BY code ORDER BY date),
      w20 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) t
  LEFT JOIN rsrs r USING (code, date)""",
    # strictly-before panel: the row a decision at `date` may see
    "asof_before": """SELECT c.date, c.idx, f.* EXCLUDE (date), f.date AS bar_date FROM (
    SELECT *, coalesce(lead(fi) OVER (PARTITION BY code ORDER BY fi), 1000000) AS nxt FROM (
      SELECT f0.*, k.idx AS fi FROM filled f0 JOIN calendar k USING (date))) f
  JOIN calendar c ON c.idx > f.fi AND c.idx <= f.nxt""",
    "filled": """SELECT * REPLACE (
    last_value(mom IGNORE NULLS) OVER w AS mom, last_value(vol_factor IGNORE NULLS) OVER w AS vol_factor,
    last_value(vol_ratio IGNORE NULLS) OVER w AS vol_ratio,
    last_value(rsrs_r2 IGNORE NULLS) OVER w AS rsrs_r2,
    last_value(rsrs_zscore IGNORE NULLS) OVER w AS rsrs_zscore,
    last_value(rsrs_adaptive IGNORE NULLS) OVER w AS rsrs_adaptive)
  FROM factors WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)""",
}


def _needs(sql: str, extra: dict[str, str]) -> list[str]:
    pool = {**CTES, **extra}
    found: list[str] = []

    def visit(text: str, above: tuple[str, ...]):
        for name in pool:
            if name in above or name in found:
                continue
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(pool[name], above + (name,))
                found.append(name)

    visit(sql, ())
    return found


def with_views(sql: str, **extra: str) -> str:
    """``sql`` with a WITH clause for every view (or extra CTE) it reads, dependencies first."""
    pool = {**CTES, **extra}
    names = _needs(sql, extra)
    if not names:
        return sql
    recursive = "RECURSIVE " if any("UNION ALL" in pool[n] and re.search(rf"FROM {n}\b|JOIN {n}\b", pool[n]) for n in names) else ""
    ctes = ",\n".join(f"{n} AS ({pool[n]})" for n in names)
    return f"WITH {recursive}{ctes}\n{sql}"
