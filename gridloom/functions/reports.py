"""Rows of measurements as JSON lines, and the tables that reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def load_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with a nested ``config`` laid flat beside the measurements."""
    df = spark.read.schema(schema).json(path)
    return df.select("config.*", *[c for c in df.columns if c != "config"]) if "config" in df.columns else df


def throughput(batches: DataFrame, seconds: float, bytes_per_row: int, by: list[str] | None = None) -> DataFrame:
    """samples, samples_per_s, mb_per_s of one measured pass, or of each group of it."""
    n = F.count("*")
    return batches.groupBy(*(by or [])).agg(n.alias("samples"), (n / seconds).alias("samples_per_s"), (n * bytes_per_row / seconds / 1e6).alias("mb_per_s"))


def with_ceiling(df: DataFrame, ceiling: DataFrame, keys: list[str], value: str, top: str) -> DataFrame:
    """Rows with their share of a ceiling in percent; without a ceiling, null."""
    return df.join(ceiling, keys, "left").withColumn("pct_of_ceiling", F.col(value) * 100 / F.col(top))



def as_table(df: DataFrame) -> str:
    """A report's rows (a few: aggregates) as a table in text."""
    rows = [df.columns, *([f"{x:.3f}" if isinstance(x, float) else str(x) for x in r] for r in df.collect())]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, wide)) + " |"
    return "\n".join([line(rows[0]), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, rows[1:])])
