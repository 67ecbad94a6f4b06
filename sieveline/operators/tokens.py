"""Token lengths, block packing and plan arithmetic.

The tokenizer is a column in, an array of ids out; the default, one id per code point, needs no model. Packing follows
batches of ``batch`` documents by dense ordinals: the tail of each batch is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.jsonl import running_sum


def code_points(c: Column) -> Column:
    """Ids of the default tokenizer."""
    return F.transform(F.when(c != "", F.split(c, "")).otherwise(F.array().cast("array<string>")), lambda x: F.ascii(x))


def with_tokenizer(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """A column function from a batch encoder; null texts have no ids."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.fillna("").tolist()), index=texts.index)

    return run


def packing_stats(df: DataFrame, ordinal: str, size: Column, *, block: int = 256, batch: int = 1000, keep_small: bool = False) -> DataFrame:
    """One row (documents, tokens, blocks, dropped): size is the tokens of a document with its end mark.

    ``keep_small``: a batch under one block is kept as a part of one (audit rule); else it is an error (raised when
    the row is computed). Null sizes count 0; an empty table gives zeros."""
    per = df.select(F.floor((F.col(ordinal) - 1) / batch).alias("b"), F.coalesce(size, F.lit(0)).alias("s")).groupBy("b").agg(F.count("*").alias("n"), F.sum("s").alias("t"))
    whole = F.floor(F.col("t") / block) * block
    small = F.col("t") if keep_small else F.raise_error(F.lit(f"a batch holds fewer than {block} tokens")).cast("bigint")
    kept = F.when(F.col("t") >= block, whole).otherwise(small)
    per = per.withColumn("kept", kept)
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.ceil(F.col("kept") / block)), F.lit(0)).cast("bigint").alias("blocks"), F.coalesce(F.sum(F.col("t") - F.col("kept")), F.lit(0)).alias("dropped"))


def pack_blocks(df: DataFrame, ordinal: str, ids: Column, *, block: int = 256, batch: int = 1000) -> DataFrame:
    """Rows (batch, block, ids): each batch's ids in order, cut into full blocks; a batch under one block gives none.

    Documents are cut where blocks end, by running sums of their sizes within the batch; only the pieces of one block
    come together in a group, so no array holds more than a block or a document."""
    rows = df.select(F.floor((F.col(ordinal) - 1) / batch).alias("batch"), F.col(ordinal).alias("o"), ids.alias("x")).where(F.size("x") > 0)
    order = Window.partitionBy("batch").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("pos", F.coalesce(F.sum(F.size("x")).over(order), F.lit(0)))
    first, last = F.floor(F.col("pos") / block), F.floor((F.col("pos") + F.size("x") - 1) / block)
    pieces = placed.select("batch", "o", "x", "pos", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * block - F.col("pos"))
    end = F.least(F.size("x").cast("bigint"), (F.col("block") + 1) * block - F.col("pos"))
    cut = pieces.select("batch", F.col("block").cast("int").alias("block"), F.struct("o", F.slice("x", (start + 1).cast("int"), (end - start).cast("int")).alias("x")).alias("r"))
    whole = cut.groupBy("batch", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"])).alias("ids"))
    return whole.where(F.size("ids") == block).select("batch", "block", "ids")


def coverage(df: DataFrame, ordinal: str, size: Column, *, cap_blocks: int, block: int = 256, batch: int = 1000) -> DataFrame:
    """One row (covered): documents that begin within the kept tokens of their batch and the running cap. Running sums
    are per batch, then over ranges of batches (one row each), of which no task sees all."""
    rows = df.select(F.floor((F.col(ordinal) - 1) / batch).alias("b"), F.col(ordinal).alias("o"), F.coalesce(size, F.lit(0)).alias("s"))
    pos = F.coalesce(F.sum("s").over(Window.partitionBy("b").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = rows.groupBy("b").agg(F.sum("s").alias("t")).withColumn("kept", F.when(F.col("t") >= block, F.floor(F.col("t") / block) * block).otherwise(F.col("t")))
    budget = running_sum(per, "b", "kept", "upto").withColumn("budget", F.greatest(F.lit(0), F.least(F.col("kept"), F.lit(cap_blocks * block) - (F.col("upto") - F.col("kept")))))
    return rows.withColumn("pos", pos).join(budget.select("b", "budget"), "b").agg(F.count_if(F.col("pos") < F.col("budget")).alias("covered"))


def truncation_stats(df: DataFrame, source: Column, target: Column, *, limit: int = 512) -> DataFrame:
    """One row of length statistics of pairs cut to a shared limit in proportion to their lengths (end mark added);
    below the limit the caps lie above the lengths. Null lengths count 0, pairs without tokens are left out."""
    rows = df.select(F.coalesce(source, F.lit(0)).alias("s"), F.coalesce(target, F.lit(0)).alias("t")).where("s + t > 0")
    cap = lambda c: F.floor(F.lit(limit) * F.col(c) / (F.col("s") + F.col("t")))
    rows = rows.select("s", "t", cap("s").alias("cs"), F.greatest(F.lit(0), cap("t") - 1).alias("ct"), (cap("t") - 1).alias("ct1"))
    rows = rows.select((F.least("s", "cs") + F.least("t", "ct") + 1).alias("n"), (F.least("t", "ct") + 1).alias("m"), ((F.col("s") > F.col("cs")) | (F.col("t") > F.col("ct1"))).alias("cut"))
    stats = [F.count("*").alias("samples"), F.sum("n").alias("tokens"), F.sum("m").alias("label_tokens"), F.count_if("cut").alias("truncated"), (F.count_if("cut") / F.count("*") * 100).alias("truncated_percent")]
    for name, q in (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("max", 1.0)):
        stats += [F.percentile("n", F.lit(q)).alias(f"input_{name}"), F.percentile("m", F.lit(q)).alias(f"label_{name}")]
    return rows.agg(*stats)


def step_plan(samples: int, batch: int, accumulation: int, warmup_ratio: float, epochs: int = 1) -> dict[str, int]:
    """Optimizer steps and warm-up steps of a run; arguments that make no plan raise."""
    if min(samples, batch, accumulation, epochs) < 1 or not 0 <= warmup_ratio < 1:
        raise ValueError("samples, batch, accumulation and epochs must be positive and the ratio in [0, 1)")
    steps = math.ceil(samples / (batch * accumulation)) * epochs
    return {"effective_batch": batch * accumulation, "steps": steps, "warmup_steps": math.ceil(steps * warmup_ratio)}


def step_plans(df: DataFrame, samples: str, *, batch: int, accumulation: int, warmup_ratio: float, epochs: int = 1) -> DataFrame:
    """The rows with effective_batch, steps and warmup_steps of a run over ``samples`` samples; a row of no samples and
    arguments that make no plan raise."""
    step_plan(1, batch, accumulation, warmup_ratio, epochs)
    n = F.when(F.col(samples) >= 1, F.col(samples)).otherwise(F.raise_error(F.lit("no samples")).cast("bigint"))
    out = df.withColumn("effective_batch", F.lit(batch * accumulation).cast("long")).withColumn("steps", (F.ceil(n / (batch * accumulation)) * epochs).cast("long"))
    return out.withColumn("warmup_steps", F.ceil(F.col("steps") * warmup_ratio).cast("long"))


def extrapolate(seconds: float, blocks: int, target_blocks: int) -> float:
    return seconds / blocks * target_blocks
