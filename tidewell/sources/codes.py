"""A map of stock codes to company codes from an XML list; listed companies that it lacks are found by their name, where that names one company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compatible

ENTRY = "stock_code string, corp_code string, corp_name string"
#: Words for the legal form, which a name may have or lack.
LEGAL_FORMS = r"\(주\)|주식회사|\b(?:co|ltd|inc|corp)\b\.?"


def company_name(x: Column) -> Column:
    """Letters and digits of a name in lower case, without its legal form."""
    return F.regexp_replace(F.regexp_replace(F.lower(compatible(x)), LEGAL_FORMS, ""), "[^0-9a-z가-힣]+", "")


def read_code_list(spark: SparkSession, path: str, tag: str = "list") -> DataFrame:
    """Entries of XML files; texts are trimmed, and an entry without a company code goes."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(ENTRY).load(path)
    return rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("stock_code", "corp_code", "corp_name")]).filter("corp_code <> ''")


def code_map(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """(stock_code, corp_code, corp_name, by_name): six-digit codes of the list, the last company of a code; then listed ones (code, name) that lack, by a name that one company alone has."""
    coded = entries.filter(F.length("stock_code") == 6).groupBy("stock_code").agg(F.max(F.struct("corp_code", "corp_name")).alias("c")).select("stock_code", "c.*", F.lit(False).alias("by_name"))
    names = entries.withColumn("name", company_name(F.col("corp_name"))).filter("name <> ''").groupBy("name").agg(F.count_distinct("corp_code").alias("n"), F.min(F.struct("corp_code", "corp_name")).alias("c")).filter("n = 1")
    missing = listed.select(F.trim("code").alias("stock_code"), company_name(F.col("name")).alias("name")).filter(F.length("stock_code") == 6).join(coded, "stock_code", "left_anti")
    return coded.unionByName(missing.join(names, "name").select("stock_code", "c.*", F.lit(True).alias("by_name")).distinct())
