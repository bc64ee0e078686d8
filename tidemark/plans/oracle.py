"""Reference SQL (DuckDB dialect) for every registered query.

Each string is self-contained: it re-derives the domain views from the raw
tables with CTEs and computes the result by brute force (e.g. sliding windows
by joining every row with ``generate_series`` of its windows).  Column names and
types match the Spark result.
"""

from __future__ import annotations

from ..functions.time import duration_us

# --------------------------------------------------------------------------- views

ITEM = "CAST(json_extract_string({a}props, '$.k') AS BIGINT)"

VIEWS = {
    "user_behavior": f"""user_behavior AS (
  SELECT user_id, {ITEM.format(a='')} AS item_id,
         CAST({ITEM.format(a='')} % 10 AS INTEGER) AS category_id,
         CASE WHEN event_type = 'view' THEN 'pv' ELSE event_type END AS behavior,
         ts, event_id AS seq
  FROM events)""",
    "user_events": """user_events AS (
  SELECT user_id, event_type, value, ts, event_id AS seq FROM events)""",
    "access_log": f"""access_log AS (
  SELECT printf('10.0.%d.%d', (e.user_id // 256) % 256, e.user_id % 256) AS ip,
         CAST(e.user_id AS VARCHAR) AS user_id, e.ts, 'GET' AS method, p.url, e.event_id AS seq
  FROM events e JOIN pages p
    ON p.page_id = ({ITEM.format(a='e.')} * {ITEM.format(a='e.')} + e.user_id) % (SELECT count(*) FROM pages))""",
    "marketing": """marketing AS (
  SELECT CAST(e.user_id AS VARCHAR) AS user_id,
         CASE WHEN e.event_type = 'error' THEN 'UNINSTALL' ELSE upper(e.event_type) END AS behavior,
         c.c_mktsegment AS channel, e.ts, e.event_id AS seq
  FROM events e JOIN customer c ON c.c_custkey = e.user_id)""",
    "ad_click": f"""ad_click AS (
  SELECT e.user_id, {ITEM.format(a='e.')} % 5 AS ad_id, n.n_name AS province,
         c.c_mktsegment AS city, e.ts, e.event_id AS seq
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
                JOIN nation n ON n.n_nationkey = c.c_nationkey
  WHERE e.event_type = 'click')""",
    "login": """login AS (
  SELECT user_id, printf('192.168.%d.%d', (user_id // 256) % 256, user_id % 256) AS ip,
         CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS event_type,
         ts, event_id AS seq
  FROM events)""",
    "order_events": """order_events AS (
  SELECT o_orderkey AS order_id, 'create' AS event_type, '' AS tx_id, o_orderdate AS ts,
         o_orderkey * 10 AS seq
  FROM orders
  UNION ALL
  SELECT l_orderkey, 'pay', 'tx' || CAST(l_orderkey AS VARCHAR), l_shipdate, l_orderkey * 10 + l_linenumber
  FROM lineitem)""",
    "invoice_events": """invoice_events AS (
  SELECT o_orderkey AS order_id, 'create' AS event_type, o_orderdate AS ts FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL
  SELECT o_orderkey, 'pay', o_orderdate + to_days(CAST(o_custkey % 60 AS INTEGER)) FROM orders WHERE o_orderstatus <> 'F')""",
    "receipts": """receipts AS (
  SELECT 'tx' || CAST(l_orderkey AS VARCHAR) AS tx_id, l_returnflag AS pay_channel,
         l_shipdate + to_days(CAST(floor(l_quantity) AS INTEGER)) AS ts, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem)""",
}


def with_views(*names: str, extra: list[str] | None = None) -> str:
    ctes = [VIEWS[n] for n in names] + list(extra or [])
    return "WITH " + ",\n".join(ctes) + "\n"


def us(d) -> int:
    return duration_us(d)


def slot_sql(col: str, seed: int = 61, bits: int = 29) -> str:
    mod = 1 << bits
    return (f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST({col} AS VARCHAR), ''), "
            f"lambda c: ascii(c)::BIGINT)), lambda a, c: (a * {seed} + c) % {mod})")


def sliding_windows_cte(name: str, src: str, cols: str, size, slide) -> str:
    """CTE ``name``: one row per (source row, window containing it), with ``e`` = end index."""
    size_us, slide_us = us(size), us(slide)
    if size_us % slide_us:
        raise ValueError("oracle expects size to be a multiple of slide")
    n = size_us // slide_us
    return f"""{name} AS (
  SELECT {cols}, epoch_us(ts) // {slide_us} + g.k AS e
  FROM {src}, generate_series(1, {n}) AS g(k))"""


def window_bounds(e: str, size, slide) -> str:
    size_us, slide_us = us(size), us(slide)
    return (f"make_timestamp({e} * {slide_us} - {size_us}) AS window_start, "
            f"make_timestamp({e} * {slide_us}) AS window_end")


def tumbling_bounds(w: str, size) -> str:
    size_us = us(size)
    return (f"make_timestamp({w} * {size_us}) AS window_start, "
            f"make_timestamp(({w} + 1) * {size_us}) AS window_end")


# ------------------------------------------------------------------ query builders

def sliding_count_sql(view: str, where: str, keys: list[str], size, slide) -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    src = f"(SELECT * FROM {view} WHERE {where})" if where else view
    return (with_views(view, extra=[sliding_windows_cte("w", src, ", ".join(keys + ["ts"]), size, slide)])
            + f"SELECT {window_bounds('e', size, slide)}, {kc}count(*) AS cnt FROM w GROUP BY e{', ' + k if keys else ''}")


def topn_sql(view: str, where: str, key: str, size, slide, n: int) -> str:
    inner = sliding_count_sql(view, where, [key], size, slide)
    return f"""SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY window_end ORDER BY cnt DESC, {key} ASC) AS INTEGER) AS rank
  FROM ({inner}) c) r
WHERE rank <= {n}"""
