"""Ranks and running sums over a whole frame without a task that sees all of it: keys are dealt to ranges that the key itself names, each range
counts by itself, and the ranges' totals, a row each, give the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Consecutive keys of a range.
WIDE = 1 << 16


def before(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """df (a row for each whole number ``key``) with the sum of value over all smaller keys."""
    part = F.floor(F.col(key) / WIDE).alias("_part")
    local = df.select("*", part, value.alias("_value"))
    own = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each WIDE keys
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    out = local.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0))).join(totals, "_part")
    return out.select(*df.columns, (F.col("_own") + F.col("_ahead")).cast("long").alias(name))


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the rank (from 0) of each row's ``key``, a whole number that no other row has."""
    return before(df, key, F.lit(1), name)


def ranked_by_hash(df: DataFrame, key: str, digest: Column, name: str) -> DataFrame:
    """df with the rank of each row in the order of a hex digest, then ``key``; its first four digits deal the rows."""
    local = df.withColumn("_digest", digest).withColumn("_part", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_digest", key)) - 1
    totals = local.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return local.withColumn("_own", own).join(totals, "_part").select(*df.columns, (F.col("_own") + F.col("_ahead")).cast("long").alias(name))
