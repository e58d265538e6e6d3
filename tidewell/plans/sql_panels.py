"""The panels of ``panels`` in DuckDB SQL, as common table expressions for the compared queries."""

_RATIO = "l_extendedprice / l_quantity"
PANELS = {
    "price": f"""price AS (SELECT s_nationkey AS k, n_regionkey AS market, CAST(l_shipdate AS DATE) AS t,
      first({_RATIO} ORDER BY l_orderkey, l_linenumber, {_RATIO}) AS open, MAX({_RATIO}) AS high, MIN({_RATIO}) AS low,
      ROUND(AVG({_RATIO}) + 0.0000013, 4) AS v, SUM(l_quantity) AS volume
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)""",
    "benchmark": "benchmark AS (SELECT market, t, ROUND(SUM(v * volume) / SUM(volume) + 0.0000013, 4) AS v FROM price GROUP BY 1, 2)",
    "orders_panel": """orders_panel AS (SELECT c_nationkey AS k, CAST(o_orderdate AS DATE) AS t, ROUND(AVG(o_totalprice) / 1000 + 0.0000013, 4) AS v
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
    "credit": "credit AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS t, ROUND(SUM(o_totalprice) / 1000 + 0.0000013, 4) AS v FROM orders GROUP BY 1, 2)",
    "macro": "macro AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, ROUND(AVG(o_totalprice) / 1000 + 0.0000013, 4) AS v FROM orders GROUP BY 1)",
    "trades": """trades AS (SELECT user_id AS k, CAST(ts AS DATE) AS t, user_id % 10 AS reporter,
      ROUND(value * CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE 1 END + 0.0000013, 4) AS changed, event_id AS record FROM events)""",
    "dirty": """dirty AS (SELECT * REPLACE (CASE WHEN datediff('day', DATE '1990-01-01', t) % 17 = 0 THEN NULL WHEN datediff('day', DATE '1990-01-01', t) % 23 = 0 THEN 0.0
      WHEN datediff('day', DATE '1990-01-01', t) % 97 = 0 THEN ROUND(v * 10, 4) ELSE v END AS v) FROM price)""",
    "mood": """mood AS (SELECT t, fear, news, credit_change, CASE WHEN len(past) >= 40 AND credit_change IS NOT NULL THEN len(list_filter(past, lambda x: x <= credit_change)) / len(past) END AS credit_pct FROM (
      SELECT *, list(credit_change) FILTER (credit_change IS NOT NULL) OVER (ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS past FROM (
      SELECT t, fear, ROUND(100 * price / AVG(price) OVER (ORDER BY t ROWS 19 PRECEDING) + 0.0000013, 4) AS news, ROUND((credit / lag(credit, 20) OVER (ORDER BY t) - 1) * 100 + 0.0000013, 4) AS credit_change FROM (
      SELECT CAST(o_orderdate AS DATE) AS t, ROUND(100 * AVG(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0.0 ELSE 1.0 END) + 0.0000013, 4) AS fear, ROUND(SUM(o_totalprice) / 1000 + 0.0000013, 4) AS credit, ROUND(AVG(o_totalprice) + 0.0000013, 4) AS price FROM orders GROUP BY 1))))""",
    "breadth": """breadth AS (SELECT market, t, ROUND(CASE WHEN SUM(down) OVER w > 0 THEN 100 * SUM(up) OVER w / SUM(down) OVER w END + 0.0000013, 4) AS adr FROM (
      SELECT market, t, COUNT(*) FILTER (v > p) AS up, COUNT(*) FILTER (v < p) AS down FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY t) AS p FROM price) GROUP BY 1, 2) WINDOW w AS (PARTITION BY market ORDER BY t ROWS 19 PRECEDING))""",
}


def with_panels(*names: str, sql: str) -> str:
    needed = [n for n in PANELS if n in names or (n == "price" and {"benchmark", "dirty", "breadth"} & set(names))]
    more = sql.lstrip()
    parts = ",\n".join(PANELS[n] for n in needed)
    if more[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts},\n{more[15:]}"
    if more[:5].upper() == "WITH ":
        return f"WITH {parts},\n{more[5:]}"
    return f"WITH {parts}\n{more}"


def r6(*columns: str) -> str:
    """Rounded columns, each ``expression AS name`` or a name; never a negative zero, and halves don't hang on the order of additions."""
    out = []
    for c in columns:
        e, _, name = c.rpartition(" AS ")
        out.append(f"ROUND(({e or name}) + 2.3e-10, 6) + 0.0 AS {name}")
    return ", ".join(out)
