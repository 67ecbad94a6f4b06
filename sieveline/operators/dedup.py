"""Ordered first-wins deduplication.

Keys are digests, so windows shuffle 32 bytes and an ordinal instead of texts. The first of a key is found by an
aggregate (min of the ordinal combines before the shuffle) and joined back, so a key of a third of all rows is never
sorted by one task. Null keys are keys like others unless a caller filters them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def first_wins(df: DataFrame, key: list[str], order: list[str], *, among: Column | None = None, salts: int = 16) -> DataFrame:
    """The rows with ``first_order`` (a struct of ``order``) of the first row of their key and ``is_first``.

    ``among``: only rows that fulfil it enter the set of seen keys; the others get first_order of those that do, or
    null. Ties of ``order`` are all first; a hot key is joined over ``salts`` partitions."""
    entering = df if among is None else df.where(among)
    first = entering.groupBy(*key).agg(F.min(F.struct(*order)).alias("first_order"))
    spread = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    left = df.withColumn("_salt", spread).alias("l")
    right = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("r")
    cond = F.col("l._salt") == F.col("r._salt")
    for k in key:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    out = left.join(right, cond, "left").select(*[f"l.{c}" for c in df.columns], "r.first_order")
    return out.withColumn("is_first", F.coalesce(F.col("first_order") == F.struct(*order), F.lit(False)))


def exact_dedup(df: DataFrame, text: Column, order: str, manual: Column | None = None) -> DataFrame:
    """The rows with ``reason`` and ``detail``: a manual reason, else exact_duplicate with the first kept ordinal, else
    null for kept rows. Manually excluded rows don't shadow later copies."""
    rows = df.withColumn("_key", digest(text)).withColumn("_manual", manual if manual is not None else F.lit(None).cast("string"))
    marked = first_wins(rows, ["_key"], [order], among=F.col("_manual").isNull())
    duplicate = F.col("_manual").isNull() & ~F.col("is_first")
    reason = F.when(F.col("_manual").isNotNull(), F.col("_manual")).when(duplicate, "exact_duplicate")
    return marked.withColumn("reason", reason).withColumn("detail", F.when(duplicate, F.col(f"first_order.{order}"))).withColumnRenamed("_key", "text_sha256").drop("_manual", "first_order", "is_first")


def excluded_by(df: DataFrame, order: str, exclusions: DataFrame) -> DataFrame:
    """The rows with ``manual``: the reason that an exclusion table (ordinal, reason) gives for their ordinal, else
    null. The table is reduced to one row per ordinal (its least reason); ordinals that no row has are ignored."""
    table = exclusions.where("ordinal IS NOT NULL AND reason IS NOT NULL").groupBy(F.col("ordinal").alias(order)).agg(F.min("reason").alias("manual"))
    return df.join(table, order, "left")


def excess(df: DataFrame, key: Column) -> DataFrame:
    """One row (records, distinct_keys, excess, groups): copies beyond the first, and keys with several rows."""
    per = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("groups"))
    return out.withColumn("excess", F.col("records") - F.col("distinct_keys"))


def reversed_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """One row (reversed_pairs): distinct (p, c, r) whose (p, r, c) is there too, each pair counted once; c = r is none."""
    t = df.select(F.col(prompt).alias("p"), F.col(chosen).alias("c"), F.col(rejected).alias("r")).distinct()
    flipped = t.select("p", F.col("r").alias("c"), F.col("c").alias("r"))
    return t.where("c < r").join(flipped, ["p", "c", "r"], "left_semi").agg(F.count("*").alias("reversed_pairs"))
