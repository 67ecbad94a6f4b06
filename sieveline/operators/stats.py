"""Profiles: counts, percentiles and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.jsonl import running_sum

PERCENTILES = (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("max", 1.0))


def percentiles(df: DataFrame, value: Column, prefix: str = "", by: list[str] | None = None) -> DataFrame:
    """One row (or one per group of ``by``, with its size n) of linearly interpolated percentiles; nulls are left out,
    an empty input gives nulls. The exact aggregate keeps one counter per distinct value, of which lengths have few."""
    found = [F.percentile(value, F.lit(q)).alias(prefix + n) for n, q in PERCENTILES]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *found) if by else df.agg(*found)


def floor_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row (value): the sorted value at 0-based rank floor((n - 1) * share), by running counts of distinct values,
    so that no list of all values is gathered."""
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    run = running_sum(per, "v", "n", "upto")
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return run.crossJoin(total).where(F.col("upto") > F.floor((F.col("total") - 1) * F.lit(share))).agg(F.min("v").alias("value"))  # total is one row


def context_length(system: Column, history: Column, question: Column, chosen: Column, rejected: Column) -> Column:
    """Characters of the longer sequence of a preference record; null parts count 0."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    turns = F.coalesce(F.aggregate(F.flatten(history), F.lit(0), lambda a, t: a + F.coalesce(F.length(t), F.lit(0))), F.lit(0))
    return n(system) + turns + n(question) + F.greatest(n(chosen), n(rejected))


def counts(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Rows (name, n): how many rows fulfil each condition, zeros included."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in named.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*[F.col(f"`{n}`") for n in named]))).alias("name", "n"))
