"""Landed payloads as rows, and rows as payloads: columnar JSON, provider envelopes, text fields, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNAR = "format string, series array<string>, dates array<string>, columns map<string, array<double>>"


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    """Columnar payloads (one JSON object a line) as (k, t, v); a column that is shorter than the dates is null from there on."""
    return columnar_rows(spark.read.schema(COLUMNAR).json(path))


def columnar_rows(payloads: DataFrame) -> DataFrame:
    rows = payloads.select(F.posexplode("dates").alias("i", "d"), "columns").select("i", "d", F.explode("columns").alias("k", "values"))
    return rows.select("k", F.expr("try_cast(d AS DATE)").alias("t"), F.get("values", F.col("i")).alias("v")).filter("t IS NOT NULL")


def to_columnar(df: DataFrame) -> DataFrame:
    """One payload for each series, dates in order, values rounded to six places."""
    series = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", F.round("v", 6).alias("v")))).alias("s"))
    return series.select(
        F.lit("columnar-v1").alias("format"), F.array(F.col("k").cast("string")).alias("series"), F.transform("s", lambda x: x["t"].cast("string")).alias("dates"),
        F.create_map(F.col("k").cast("string"), F.transform("s", lambda x: x["v"])).alias("columns"),
    )


def write_or_keep(df: DataFrame, path: str) -> bool:
    """Writes unless there is nothing to write: an empty result never replaces good files."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def extract_envelope(df: DataFrame, path: str, item: str) -> DataFrame:
    """Items of a provider's JSON bodies (column body) under a path, be it a list or one object; bodies without it give a row with a null item and ``failed``."""
    at = F.expr(f"try_variant_get(try_parse_json(body), '$.{path}', 'variant')")
    many = F.expr(f"try_variant_get(try_parse_json(body), '$.{path}', 'array<{item}>')")
    one = F.expr(f"try_variant_get(try_parse_json(body), '$.{path}', '{item}')")
    rows = df.withColumn("_items", F.coalesce(many, F.when(one.isNotNull(), F.array(one)))).withColumn("failed", at.isNull())
    return rows.select(*[c for c in df.columns if c != "body"], "failed", F.explode_outer("_items").alias("item"))


def decode_observations(df: DataFrame, pattern: str, scale: float = 1.0, digits: int = 4) -> DataFrame:
    """(k, t, v) of text dates and numbers with commas; rows that are neither go."""
    t = F.expr(f"try_to_date(d, '{pattern}')")
    v = F.round(F.expr("try_cast(regexp_replace(x, ',', '') AS DOUBLE)") / scale + 1e-9, digits)
    return df.select("k", t.alias("t"), v.alias("v")).filter("t IS NOT NULL AND v IS NOT NULL")


def decode_scores(df: DataFrame) -> DataFrame:
    """Scores from 0 to 100; the last one of a date wins. df: k, t, v, seq."""
    from ..operators.merge import last_wins

    return last_wins(df.filter("v BETWEEN 0 AND 100"), ["k", "t"], ["seq"]).select("k", "t", "v")


def check_segments(full: DataFrame, *segments: DataFrame) -> DataFrame:
    """Rows that the segments together have too many or too few: none when they are the full table."""
    from functools import reduce

    together = reduce(DataFrame.unionByName, segments)
    extra = together.exceptAll(full.select(*together.columns)).withColumn("problem", F.lit("extra"))
    return extra.unionByName(full.select(*together.columns).exceptAll(together).withColumn("problem", F.lit("missing")))


def html_array(html: Column, name: str) -> Column:
    """An array of [milliseconds, value] pairs that a page's script assigns to a name."""
    return F.from_json(F.regexp_extract(html, rf"\b{name}\s*=\s*(\[\[.*?\]\])", 1), "array<array<double>>")


def csv_rows(lines: DataFrame) -> DataFrame:
    """(t, v) of text lines ``date,value``; a value that is no number is null, a line without a date goes."""
    parsed = lines.select(F.from_csv("line", "d STRING, x STRING", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(F.expr("try_cast(r.d AS DATE)").alias("t"), F.expr("try_cast(r.x AS DOUBLE)").alias("v")).filter("t IS NOT NULL")


def pick_best_match(df: DataFrame, wanted: str) -> DataFrame:
    """(t, score, v): of each date the row (k, t, v, name) whose name is the wanted one (100) or holds it (50); of equals the smallest key."""
    name = F.upper(F.regexp_replace("name", r"\s+", ""))
    score = F.when(name == wanted, 100).when(name.contains(wanted), 50)
    rows = df.withColumn("score", score).filter("score IS NOT NULL")
    return rows.groupBy("t").agg(F.max("score").alias("score"), F.max_by("v", F.struct(F.col("score"), -F.col("k"))).alias("v"))


def check_alignment(source: DataFrame, output: DataFrame, calendar: DataFrame) -> DataFrame:
    """By key: whether the output reaches the source's latest date, or the first market day from there on."""
    a = source.groupBy("k").agg(F.max("t").alias("source_latest"))
    b = output.groupBy("k").agg(F.max("t").alias("output_latest"))
    days = calendar.select("t").distinct()
    needed = a.join(F.broadcast(days), F.col("t") >= F.col("source_latest"), "left").groupBy("k", "source_latest").agg(F.min("t").alias("needed"))
    rows = needed.join(b, "k", "left")
    return rows.withColumn("aligned", F.coalesce(F.col("output_latest") >= F.coalesce("needed", "source_latest"), F.lit(False)))


def decode_filings(df: DataFrame, unimportant: str) -> DataFrame:
    """Filings (k, d: yyyyMMdd, title, id) with dates, without unimportant titles, the last of each key, date and title."""
    rows = df.withColumn("t", F.expr("try_to_date(d, 'yyyyMMdd')")).filter(F.col("t").isNotNull() & ~F.col("title").rlike(unimportant))
    return rows.groupBy("k", "t", "title").agg(F.max("id").alias("id"))


def decode_price_text(df: DataFrame) -> DataFrame:
    """(k, t, open, high, low, v, volume) of bodies whose items have ``yyyyMMdd|open|high|low|close|volume`` as an attribute."""
    items = F.regexp_extract_all("body", F.lit(r'data="(\d{8}\|[^"]*)"'), F.lit(1))
    rows = df.select("k", F.explode(items).alias("i")).select("k", F.split("i", r"\|").alias("p"))
    number = lambda n, kind: F.expr(f"try_cast(get(p, {n}) AS {kind})")
    out = rows.select("k", F.expr("try_to_date(get(p, 0), 'yyyyMMdd')").alias("t"), *[number(n, "DOUBLE").alias(c) for n, c in enumerate(("open", "high", "low", "v"), 1)], number(5, "BIGINT").alias("volume"))
    return out.filter("t IS NOT NULL AND v IS NOT NULL")


def volatility_rows(df: DataFrame) -> DataFrame:
    """Rows (k, t, v, open, seq) of a volatility index with a positive close; other fields only where positive; the last of a date wins."""
    from ..operators.merge import last_wins

    rows = last_wins(df.filter("v > 0"), ["k", "t"], ["seq"])
    return rows.select("k", "t", "v", F.when(F.col("open") > 0, F.col("open")).alias("open"))


def live_universe(df: DataFrame, n: int) -> DataFrame:
    """Members (market, raw code, cap as text) with six-digit codes and a capitalisation, the first of each market by it."""
    from pyspark.sql import Window

    code = F.lpad(F.regexp_extract("raw", r"(\d+)", 1), 6, "0")
    rows = df.select("market", code.alias("code"), F.expr("try_cast(regexp_replace(cap, ',', '') AS DOUBLE)").alias("cap")).filter("cap > 0 AND market IN ('main', 'growth')")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("cap"), "code"))).filter(F.col("rank") <= n)
