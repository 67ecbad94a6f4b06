"""Deterministic sampling, splits and seeded order, by SHA-256 of seed and record."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, json_text: Column, n: int, order: str, seed: str = "42", *, strict: bool = False) -> DataFrame:
    """The n rows of lowest SHA-256(seed + JSON), with ``sample_hash``; ties keep the larger ordinal. Plans as a top-n,
    so no full sort. Null JSON is never sampled. Strict: fewer than n rows raise."""
    rows = df.withColumn("sample_hash", F.sha2(F.concat(F.lit(seed), json_text), 256)).where("sample_hash IS NOT NULL")
    out = rows.orderBy("sample_hash", F.desc(order)).limit(n)
    if strict and out.count() < n:
        raise ValueError(f"fewer than {n} rows to sample")
    return out


def seeded_split(df: DataFrame, key: Column, validation: int, seed: str, *, strict: bool = False) -> DataFrame:
    """The rows with ``split``: the ``validation`` rows of lowest seeded hash are validation, the others train. The
    cut-off is one value, so no row is gathered. Strict: there must be more rows than go to validation."""
    rows = df.withColumn("_h", F.sha2(F.concat(F.lit(seed), key.cast("string")), 256))
    lowest = rows.select("_h").orderBy("_h").limit(validation)
    cut = lowest.agg(F.max("_h").alias("m"), F.count("*").alias("n")).first()
    if strict and (cut.n < validation or rows.select("_h").limit(validation + 1).count() <= validation):
        raise ValueError(f"too few rows to set {validation} aside")
    return rows.withColumn("split", F.when(F.col("_h") <= F.lit(cut.m if validation else ""), "validation").otherwise("train")).drop("_h")


def shuffled_ordinals(n: int, seed: int) -> list[int]:
    """The permutation that a seeded Mersenne generator gives 0..n-1: for exact replays of small sets, on the driver."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def split_prompts(train: DataFrame, validation: DataFrame, key: Column, order: str, *, train_size: int, eval_size: int, seed: str) -> DataFrame:
    """Rows of both frames with ``split``: the ``train_size`` rows of lowest seeded hash of the training frame, and the
    first ``eval_size`` rows of the validation frame in their order. Ties keep the smaller ordinal; frames that are too
    small come whole."""
    hashed = train.withColumn("_h", F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)).orderBy("_h", order).limit(train_size).drop("_h")
    return hashed.withColumn("split", F.lit("train")).unionByName(head(validation, eval_size, order).withColumn("split", F.lit("validation")))


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in order (all if there are fewer, none of an empty frame)."""
    return df.orderBy(order).limit(n)
