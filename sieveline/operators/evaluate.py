"""Evaluation analytics: choices, accuracies, paired tests, perplexity, preference and A/B summaries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import salted_join


def best_choice(scores: Column, choices: tuple[str, ...] = ("A", "B", "C", "D")) -> Column:
    """The first choice with the highest score in a map choice -> score; null without scores."""
    values = F.array(*[scores[c] for c in choices])
    at = F.array_position(values, F.array_max(values))
    return F.when(at > 0, F.element_at(F.array(*map(F.lit, choices)), F.when(at > 0, at.cast("int")).otherwise(1)))


def accuracy(df: DataFrame, subject: str, gold: str, prediction: str) -> DataFrame:
    """Rows (subject, correct, total, accuracy). A null prediction is wrong."""
    right = F.coalesce(F.col(gold) == F.col(prediction), F.lit(False))
    return df.groupBy(F.col(subject).alias("subject")).agg(F.count_if(right).alias("correct"), F.count("*").alias("total"), F.avg(right.cast("int")).alias("accuracy"))


def micro_macro(per_subject: DataFrame) -> DataFrame:
    """One row (correct, total, micro, macro); macro is the unweighted mean of the subjects."""
    return per_subject.agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), (F.sum("correct") / F.sum("total")).alias("micro"), F.avg("accuracy").alias("macro"))


def mcnemar(left_only: Column, right_only: Column) -> Column:
    """Two-sided exact McNemar p of the discordant counts, by the binomial recurrence in logarithms."""
    n, k = left_only + right_only, F.least(left_only, right_only)
    step = lambda s, i: F.struct((s["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("t"), (s["p"] + F.exp(s["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))).alias("p"))
    first = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("p"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), first, step, lambda s: s["p"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired(left: DataFrame, right: DataFrame, keys: list[str], gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """One row (pairs, both, left_only, right_only, p_value). Keys must be unique, equal on both sides and of equal
    gold; otherwise the row raises when it is computed."""
    l = left.select(*keys, F.col(gold).alias("lg"), F.coalesce(F.col(gold) == F.col(prediction), F.lit(False)).alias("lc"), F.lit(1).alias("ln"))
    r = right.select(*keys, F.col(gold).alias("rg"), F.coalesce(F.col(gold) == F.col(prediction), F.lit(False)).alias("rc"), F.lit(1).alias("rn"))
    one = lambda d, n: d.groupBy(*keys).agg(F.sum(n).alias(n), *[F.first(c).alias(c) for c in d.columns if c not in (*keys, n)])
    both = one(l, "ln").join(one(r, "rn"), keys, "full_outer")
    bad = (F.coalesce(F.col("ln"), F.lit(0)) != 1) | (F.coalesce(F.col("rn"), F.lit(0)) != 1) | ~F.col("lg").eqNullSafe(F.col("rg"))
    out = both.agg(F.count("*").alias("pairs"), F.count_if(F.col("lc") & F.col("rc")).alias("both"), F.count_if(F.col("lc") & ~F.col("rc")).alias("left_only"), F.count_if(~F.col("lc") & F.col("rc")).alias("right_only"), F.count_if(bad).alias("bad"))
    out = out.where(F.when(F.col("bad") > 0, F.raise_error(F.lit("the two sides don't hold the same questions once each"))).otherwise(F.lit(True)))
    return out.withColumn("p_value", mcnemar(F.col("left_only"), F.col("right_only"))).drop("bad")


def perplexity(df: DataFrame, loss: Column, count: Column) -> DataFrame:
    """One row (predicted_tokens, loss, perplexity) of losses weighted by their token counts."""
    total = F.sum(count)
    mean = F.sum(loss * count) / total
    return df.agg(total.alias("predicted_tokens"), mean.alias("loss"), F.exp(mean).alias("perplexity"))


def ab_summary(df: DataFrame, a: str, b: str, tie: float = 1e-6) -> DataFrame:
    """One row of means, delta, wins, ties and losses of branch b against a (columns <branch>_reward, _tokens,
    _terminated); nulls make no comparison."""
    delta = F.col(f"{b}_reward") - F.col(f"{a}_reward")
    mean = lambda x: F.avg(x)
    return df.agg(
        F.count("*").alias("samples"), mean(f"{a}_reward").alias("a_reward_mean"), mean(f"{b}_reward").alias("b_reward_mean"), mean(delta).alias("reward_delta_mean"),
        F.count_if(delta > tie).alias("b_wins"), F.count_if(F.abs(delta) <= tie).alias("ties"), F.count_if(delta < -tie).alias("a_wins"),
        mean(f"{a}_tokens").alias("a_mean_tokens"), mean(f"{b}_tokens").alias("b_mean_tokens"),
        mean(F.col(f"{a}_terminated").cast("double")).alias("a_termination_rate"), mean(F.col(f"{b}_terminated").cast("double")).alias("b_termination_rate"),
    )


def preference_metrics(df: DataFrame, chosen: Column, rejected: Column) -> DataFrame:
    return df.agg(F.avg((chosen > rejected).cast("int")).alias("accuracy"), F.avg(chosen - rejected).alias("margin"))


# The length guard's limits in tokens and its rewards.
def length_guard(text: Column, tokens: Column) -> Column:
    """Reward of a completion's length: blank -1, under 8 tokens -0.4, under 20 -0.1, else 0."""
    blank = text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")
    return F.when(blank, -1.0).when(tokens < 8, -0.4).when(tokens < 20, -0.1).otherwise(0.0)


def group_scaled(df: DataFrame, prompt: str, rewards: list[Column], weights: list[float]) -> DataFrame:
    """The rows with ``reward`` (weighted sum) and ``advantage`` (scaled by mean and deviation within the prompt; 0 where
    all rewards are equal). A prompt of a third of all rows is spread over tasks; rows of a null prompt are left out."""
    total = None
    for r, w in zip(rewards, weights):
        total = r * w if total is None else total + r * w
    per = df.withColumn("reward", total)
    stats = per.groupBy(prompt).agg(F.avg("reward").alias("_m"), F.stddev_samp("reward").alias("_s"))
    return salted_join(per, stats, [prompt]).withColumn("advantage", F.when(F.col("_s") > 1e-12, (F.col("reward") - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before != 0, (after / before - 1) * 100)


def consistency(df: DataFrame, loss: Column, ppl: Column) -> DataFrame:
    """Rows whose loss is not finite or whose perplexity isn't exp(loss) to one part in a million."""
    finite = loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) != float("inf"))
    close = F.abs(F.exp(loss) - ppl) <= 1e-6 * F.greatest(F.abs(ppl), F.abs(F.exp(loss)))
    return df.where(~F.coalesce(finite & close, F.lit(False)))


def text_report(values: dict[str, float], base: dict[str, float] | None = None) -> str:
    """Lines of name, value to four places and the change against a base in percent."""
    lines = []
    for name, v in values.items():
        change = f"{(v / base[name] - 1) * 100:+10.4f}%" if base and base.get(name) else ""
        lines.append(f"{name:<24}{v:>12.4f}{change}".rstrip())
    return "\n".join(lines)


def scored(df: DataFrame, inputs: list[str], score: Callable[[pd.DataFrame], pd.Series], name: str = "score") -> DataFrame:
    """The rows with a model's score: a function from a batch of inputs to a column of numbers."""

    @F.pandas_udf("double")
    def run(batch: pd.DataFrame) -> pd.Series:
        return score(batch).astype("float64")

    return df.withColumn(name, run(F.struct(*inputs)))
