"""Queries of versioned tables, upserting streams, availability lags on streams, and crisis scores, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import crisis as C
from .operators import news as N
from .plans import panels as P
from .plans.sql_panels import r6
from .queries import KT, query
from .sources import codes as CM
from .sources import versioned as V
from .streaming import landing as L
from .streaming import streams as ST

MONTHS = "date_format(t, 'yyyy-MM')"


def _folder(s, purpose: str) -> str:
    return f"{ST.shared_folder(s)}/{purpose}-{uuid.uuid4().hex}"


# ---- upserts: three landings of the price panel, with revisions, faults and rows that come too late

_LANDINGS = f"""WITH a AS (SELECT k, t, v FROM price WHERE t < DATE '1996-01-01'),
    b AS (SELECT k, t, CASE WHEN t >= DATE '1996-01-01' THEN v WHEN k % 5 = 0 THEN v * 3 ELSE v * 1.01 END AS v FROM price WHERE t >= DATE '1995-06-01' AND t < DATE '1998-01-01'),
    c AS (SELECT k, t, CASE WHEN t >= DATE '1998-01-01' AND datediff('day', DATE '1990-01-01', t) % 17 = 0 THEN -1.0 ELSE v END AS v FROM price WHERE t >= DATE '1998-01-01' OR (day(t) = 15 AND year(t) = 1995)),
    {{steps}}"""


def _step(name: str, table: str, batch: int) -> str:
    """The rows of one landing with their reasons, and the table after it."""
    return f"""r{name} AS (SELECT n.k, n.t, n.v, h.v AS held, CASE WHEN n.v <= 0 THEN 'invalid' WHEN n.t < l.latest - 45 THEN 'settled' WHEN h.v > 0 AND (n.v / h.v > 1.8 OR n.v / h.v < 1 / 1.8) THEN 'jump' END AS reason, {batch} AS batch
      FROM {name} n LEFT JOIN {table} h USING (k, t) LEFT JOIN (SELECT k, MAX(t) AS latest FROM {table} GROUP BY 1) l ON l.k = n.k),
    s{name} AS (SELECT k, t, coalesce(n.v, h.v) AS v FROM {table} h FULL JOIN (SELECT k, t, v FROM r{name} WHERE reason IS NULL) n USING (k, t))"""


_STEPS = _LANDINGS.format(steps="none AS (SELECT * FROM a WHERE FALSE), " + ", ".join(_step(n, t, i) for i, (n, t) in enumerate((("a", "none"), ("b", "sa"), ("c", "sb")))))


def landed(s, d):
    """The table after three landings, between which the stream stops."""
    rows = KT(P.price(s, d))
    first, second = F.lit("1996-01-01").cast("date"), F.lit("1998-01-01").cast("date")
    day = F.datediff("t", F.lit("1990-01-01"))
    parts = [
        rows.filter(F.col("t") < first),
        rows.filter((F.col("t") >= "1995-06-01") & (F.col("t") < second)).withColumn("v", F.when(F.col("t") >= first, F.col("v")).when(F.col("k") % 5 == 0, F.col("v") * 3).otherwise(F.col("v") * 1.01)),
        rows.filter((F.col("t") >= second) | ((F.dayofmonth("t") == 15) & (F.year("t") == 1995))).withColumn("v", F.when((F.col("t") >= second) & (day % 17 == 0), -1.0).otherwise(F.col("v"))),
    ]
    folder = _folder(s, "landing")
    schema = rows.withColumn("seq", F.lit(0)).schema
    landing = L.Landing(s, folder, dict(rows.dtypes)["k"], MONTHS)
    for i, part in enumerate(parts):
        part.withColumn("seq", F.lit(i)).write.mode("append").parquet(folder + "/in")
        landing.run(s.readStream.schema(schema).parquet(folder + "/in"))
    return landing


@query("st3_upsert_stream", f"{_STEPS} SELECT k, t, {r6('v')} FROM sc", ("price",))
def _(s, d):
    return landed(s, d).table.read()


@query("st2_quarantine", f"{_STEPS} SELECT batch, k, t, reason, {r6('v', 'held')} FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb UNION ALL SELECT * FROM rc) WHERE reason IS NOT NULL", ("price",))
def _(s, d):
    return landed(s, d).quarantined().select("batch", "k", "t", "reason", "v", "held")


@query("s4_versioned_write", f"SELECT k, t, {r6('v')} FROM price WHERE k % 2 = 0", ("price",))
def _(s, d):
    """A full write, one of the even keys in its place, and an empty one, which changes nothing."""
    rows = KT(P.price(s, d))
    table = V.VersionedTable(s, _folder(s, "versioned"), f"k {dict(rows.dtypes)['k']}, t date, v double", "k")
    table.replace(rows)
    table.replace(rows.filter("k % 2 = 0"))
    table.replace(rows.filter("false"))
    return table.read()


@query("s6_versioned_manifest", "SELECT k, COUNT(*) AS n, MIN(t) AS first_t, MAX(t) AS latest, (SELECT COUNT(*) FROM price WHERE k % 2 = 0) AS total FROM price WHERE k % 2 = 0 GROUP BY 1", ("price",))
def _(s, d):
    """Files by key: keys that the second write lacks have none left."""
    rows = KT(P.price(s, d))
    table = V.VersionedTable(s, _folder(s, "versioned"), f"k {dict(rows.dtypes)['k']}, t date, v double", "k")
    table.replace(rows)
    table.replace(rows.filter("k % 2 = 0"))
    table.vacuum(1)
    total = sum(p["rows"] for p in table.manifest()["parts"].values())
    return V.summary(table).select("k", "n", "first_t", "latest", F.lit(total).cast("long").alias("total"))


# ---- availability lags on streams


def _streams(s, d):
    """Prices, and the second provider's series, as streams from landing folders; the end of times last."""
    folder = _folder(s, "lags")
    left, right = KT(P.price(s, d)), P.orders_panel(s, d)
    for name, df in (("l", left), ("r", right)):
        df.select(F.col("k").cast("int").alias("k"), "t", "v").write.parquet(f"{folder}/{name}")
    schema = "k int, t date, v double"
    sides = lambda: [s.readStream.schema(schema).parquet(f"{folder}/{n}") for n in "lr"]
    ST.drained(ST.asof_stream(*sides(), 20, 60), folder)
    mark = s.range(1).select(F.lit(-1).alias("k"), F.lit(ST.END).cast("date").alias("t"), F.lit(0.0).alias("v"))
    for n in "lr":
        mark.write.mode("append").parquet(f"{folder}/{n}")
    return ST.drained(ST.asof_stream(*sides(), 20, 60), folder)


@query(
    "st9_asof_stream",
    f"""WITH r AS (SELECT k, t, v, t + 20 AS known FROM orders_panel), x AS (SELECT p.k, p.t, p.v, arg_max(r.t, r.t) AS t_right, arg_max(r.v, r.t) AS v_right FROM price p LEFT JOIN r ON r.k = p.k AND r.known <= p.t AND r.known >= p.t - 60 GROUP BY 1, 2, 3)
    SELECT k, t, t_right, {r6('v', 'v_right')} FROM x""",
    ("price", "orders_panel"),
)
def _(s, d):
    return _streams(s, d)


# ---- crisis scores: regions as countries, their readings made of the benchmark

_NAMES = {"curve2y": "ROUND(AVG(v % 4) OVER (PARTITION BY market ORDER BY t ROWS 19 PRECEDING) - 1.9 + 1.3e-7, 4)", "curve3m": "ROUND(AVG(v % 4) OVER (PARTITION BY market ORDER BY t ROWS 39 PRECEDING) - 2 + 1.3e-7, 4)", "spread": "ROUND(1 + v % 3 + 1.3e-7, 4)", "vix": "ROUND(10 + v % 30 + 1.3e-7, 4)", "fx": "ROUND(1000 + v % 400 + 1.3e-7, 4)"}
_MONTHLY = {"unemployment": "3 + v % 5", "sahm": "(v % 8) / 10", "funds": "v % 6"}
_CRISIS_SQL = f"""WITH RECURSIVE s AS (SELECT market AS k, 'claims' AS name, t, ROUND(200 + v % 50 + 1.3e-7, 4) AS v FROM benchmark WHERE dayofweek(t) = 4
      UNION ALL {' UNION ALL '.join(f"SELECT market, '{n}', t, {e} FROM benchmark WHERE t > DATE '1992-03-01'" for n, e in _NAMES.items())}
      UNION ALL {' UNION ALL '.join(f"SELECT market, '{n}', t, ROUND({e} + 1.3e-7, 4) FROM benchmark WHERE day(t) = 1" for n, e in _MONTHLY.items())}),
    o AS (SELECT *, lag(v, CASE name WHEN 'vix' THEN 20 WHEN 'fx' THEN 20 WHEN 'funds' THEN 6 ELSE 63 END) OVER w AS before, AVG(v) OVER (w ROWS 3 PRECEDING) AS mean4, coalesce(MIN(v) OVER (w ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING), v) AS low FROM s WINDOW w AS (PARTITION BY k, name ORDER BY t)),
    d AS (SELECT DISTINCT k, t FROM s WHERE name IN ('curve2y', 'curve3m', 'spread', 'vix', 'fx')),
    j AS (SELECT d.k, d.t, {', '.join(f"{n}.v AS {n}, {n}.before AS {n}_b" for n in C.SERIES)}, claims.mean4, claims.mean4 / claims.low - 1 AS rise FROM d {' '.join(f"ASOF LEFT JOIN (SELECT * FROM o WHERE name = '{n}') {n} ON {n}.k = d.k AND {n}.t <= d.t" for n in C.SERIES)}),
    a AS (SELECT *, coalesce(curve2y < 0, FALSE) OR coalesce(curve3m < 0, FALSE) AS active FROM j WHERE curve2y IS NOT NULL OR curve3m IS NOT NULL),
    b AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY k ORDER BY t), FALSE) AS was FROM a),
    e AS (SELECT *, CASE WHEN active THEN t - MAX(CASE WHEN active AND NOT was THEN t END) OVER w ELSE 0 END AS days, t - MAX(CASE WHEN active THEN t END) OVER w AS since, t - MAX(CASE WHEN NOT active AND was THEN t END) OVER w AS since_end FROM b WINDOW w AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, NOT active AND coalesce(since_end <= 365, FALSE) AS uninversion, least(40, CASE WHEN active THEN 12 + least(12, days / 30) + CASE WHEN curve2y < 0 AND curve3m < 0 THEN 4 ELSE 0 END
        WHEN since_end <= 365 THEN 24 + greatest(0, least(1, coalesce(greatest(curve2y - curve2y_b, curve3m - curve3m_b), 0) / 0.8)) * 10 + greatest(0, 1 - since_end / 365) * 6
        WHEN since <= 548 THEN 8 + (1 - since / 548) * 8 ELSE 0 END) AS c,
      greatest(0, least(1, (coalesce(sahm, 0) - 0.1) / 0.65)) * 20 + greatest(0, least(1, (coalesce(rise, 0) - 0.05) / 0.25)) * 10 AS l, greatest(0, least(1, (coalesce(spread, 0) - 1.5) / 2.5)) * 20 + greatest(0, least(1, coalesce(spread - spread_b, 0) - 0.1)) * 10 AS dd FROM e),
    g AS (SELECT *, CASE WHEN uninversion AND l < 8 AND dd < 8 THEN least(c + l + dd, 49) ELSE least(c + l + dd, 100) END AS raw FROM f),
    h AS (SELECT *, CAST(floor(CASE WHEN raw >= 75 AND (l < 12 OR dd < 10) THEN 74 ELSE raw END + 0.5) AS INTEGER) AS score FROM g),
    scores AS (SELECT *, CASE WHEN score >= 75 THEN 'crisis' WHEN score >= 50 THEN 'warning' WHEN score >= 25 THEN 'caution' ELSE 'stable' END AS stage FROM h)"""  # fmt: skip
_READINGS = f"""k, t, score, CAST(floor(c + 0.5) AS INTEGER) AS curve, CAST(floor(l + 0.5) AS INTEGER) AS labor, CAST(floor(dd + 0.5) AS INTEGER) AS credit, stage, uninversion, CAST(floor(mean4 + 0.5) AS INTEGER) AS claims4,
    {r6('curve2y', 'curve3m', 'unemployment', 'spread', 'sahm', 'funds', 'funds - funds_b AS funds_change', 'vix', 'vix / vix_b - 1 AS vix_change', 'fx', 'fx / fx_b - 1 AS fx_change')}"""


def _readings(s, d):
    rows = P.benchmark(s, d).withColumnRenamed("market", "k")
    w = Window.partitionBy("k").orderBy("t")
    four = lambda x: F.round(x + 1.3e-7, 4)
    mean = lambda n, x: four(F.avg(F.col("v") % 4).over(w.rowsBetween(-n + 1, 0)) - x)
    wide = rows.select("k", "t", mean(20, 1.9).alias("curve2y"), mean(40, 2).alias("curve3m"), *[four(x).alias(n) for n, x in {"spread": 1 + F.col("v") % 3, "vix": 10 + F.col("v") % 30, "fx": 1000 + F.col("v") % 400, "claims": 200 + F.col("v") % 50, "unemployment": 3 + F.col("v") % 5, "sahm": (F.col("v") % 8) / 10, "funds": F.col("v") % 6}.items()])
    long = wide.unpivot(["k", "t"], list(C.SERIES), "name", "v")
    daily, monthly = list(_NAMES), list(_MONTHLY)
    return long.filter((F.col("name").isin(daily) & (F.col("t") > "1992-03-01")) | (F.col("name").isin(monthly) & (F.dayofmonth("t") == 1)) | ((F.col("name") == "claims") & (F.dayofweek("t") == 5)))


@query("m1_crisis_score", f"{_CRISIS_SQL} SELECT {_READINGS} FROM scores", ("benchmark",))
def _(s, d):
    return C.crisis_scores(_readings(s, d))


@query(
    "m1_crisis_reports",
    _CRISIS_SQL
    + """, n AS MATERIALIZED (SELECT k, t, score, stage, row_number() OVER (PARTITION BY k ORDER BY t) AS i, COUNT(*) OVER (PARTITION BY k) AS n FROM scores),
    p AS (SELECT k, i, t, score, stage, t AS last_t, stage AS last_stage, TRUE AS kept FROM n WHERE i = 1
      UNION ALL SELECT n.k, n.i, n.t, n.score, n.stage, CASE WHEN n.t - p.last_t >= 7 OR n.stage <> p.last_stage OR n.i = n.n THEN n.t ELSE p.last_t END, CASE WHEN n.t - p.last_t >= 7 OR n.stage <> p.last_stage OR n.i = n.n THEN n.stage ELSE p.last_stage END, n.t - p.last_t >= 7 OR n.stage <> p.last_stage OR n.i = n.n FROM p JOIN n ON n.k = p.k AND n.i = p.i + 1)
    SELECT k, t, score, stage FROM p WHERE kept""",
    ("benchmark",),
)
def _(s, d):
    return C.reported(C.crisis_scores(_readings(s, d))).select("k", "t", "score", "stage")


# ---- news: orders told as headlines of their nations


@query("m32_news_clusters")
def _(s, d):
    orders, customers, nations = (P.table(s, d, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    title = F.concat_ws(" ", F.concat(F.lit("["), "o_orderpriority", F.lit("]")), "n_name", F.lower("c_mktsegment"), F.lit("order worth about"), F.round(F.col("o_totalprice") / 40000).cast("int").cast("string"), F.lit("is"), "o_orderstatus")
    return N.cluster_news(rows.select(F.col("c_nationkey").alias("k"), F.to_date("o_orderdate").alias("t"), title.alias("title"), F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("source")))


# ---- a code map from XML: suppliers as companies, some without a stock code, some with names that others have too


@query(
    "s19_code_map",
    """WITH e AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN printf('%06d', s_suppkey) ELSE '' END AS stock_code, printf('%08d', s_suppkey) AS corp_code, CASE WHEN s_suppkey % 5 = 0 THEN '(주) 회사 ' || (s_suppkey // 10) ELSE '주식회사 ' || s_name END AS corp_name FROM supplier),
    l AS (SELECT printf('%06d', s_suppkey) AS code, CASE WHEN s_suppkey % 5 = 0 THEN '회사' || (s_suppkey // 10) ELSE lower(replace(s_name, '#', '')) END AS name FROM supplier),
    c AS (SELECT stock_code, corp_code, corp_name, FALSE AS by_name FROM e WHERE stock_code <> ''), n AS (SELECT lower(regexp_replace(replace(replace(corp_name, '(주)', ''), '주식회사', ''), '[^0-9A-Za-z가-힣]+', '', 'g')) AS name, MIN(corp_code) AS corp_code, MIN(corp_name) AS corp_name FROM e GROUP BY 1 HAVING COUNT(*) = 1)
    SELECT * FROM c UNION ALL SELECT l.code, n.corp_code, n.corp_name, TRUE FROM l JOIN n ON regexp_replace(l.name, '[^0-9a-z가-힣]+', '', 'g') = n.name WHERE l.code NOT IN (SELECT stock_code FROM c)""",
)
def _(s, d):
    key, name = F.col("s_suppkey"), F.concat(F.lit("회사"), F.floor(F.col("s_suppkey") / 10).cast("string"))
    rows = P.table(s, d, "supplier")
    odd = key % 5 != 0
    entries = rows.select(
        F.when(key % 3 == 0, F.lpad(key.cast("string"), 6, "0")).otherwise("").alias("stock_code"), F.lpad(key.cast("string"), 8, "0").alias("corp_code"),
        F.when(odd, F.concat(F.lit("주식회사 "), "s_name")).otherwise(F.concat(F.lit("(주) 회사 "), F.floor(key / 10).cast("string"))).alias("corp_name"),
    )
    folder = _folder(s, "codes")
    entries.write.format("xml").option("rowTag", "list").option("rootTag", "result").save(folder)
    listed = rows.select(F.lpad(key.cast("string"), 6, "0").alias("code"), F.when(odd, F.lower(F.replace("s_name", F.lit("#"), F.lit("")))).otherwise(name).alias("name"))
    return CM.code_map(CM.read_code_list(s, folder), listed)
