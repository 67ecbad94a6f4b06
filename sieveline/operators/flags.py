"""Record validity and lexical flags. Null texts match no pattern and are invalid where a text is required."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import is_blank

# The pattern catalogue of the review rules.
PATTERNS = {
    "replacement_character": "�",
    "absolute_claim": "根治|包治|百分之百|百分百|无副作用|保证治愈|一定能治",
    "folk_remedy": "偏方|秘方|祖传",
    "contact_or_promotion": "加微信|加QQ|联系电话|咨询热线|点击购买",
    "phone_like": r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)",
    "url": r"https?://|www\.",
    "hypertension_infertility_cooccurrence": r"高血压[\s\S]{0,100}不孕|不孕[\s\S]{0,100}高血压",
}
#: Patterns whose hit excludes a record; all others are only counted.
EXCLUDING = ("replacement_character", "contact_or_promotion", "phone_like", "url")


@dataclass(frozen=True)
class Rules:
    """A catalogue of patterns, those that exclude, and the length limits of the length flags."""

    patterns: dict[str, str] = field(default_factory=lambda: dict(PATTERNS))
    excluding: tuple[str, ...] = EXCLUDING
    short_text: int = 20
    short_answer: int = 10
    long_answer: int = 4000


def hit(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def flags(c: Column, rules: Rules = Rules()) -> dict[str, Column]:
    """One boolean column per pattern; literal patterns without metacharacters are plain searches."""
    plain = set("\\.[](){}?*+|^$")
    return {n: F.coalesce(c.contains(p), F.lit(False)) if plain.isdisjoint(p) else hit(c, p) for n, p in rules.patterns.items()}


def valid_text(c: Column) -> Column:
    return ~is_blank(c)


def valid_dialogue(turns: Column, role: str = "role") -> Column:
    """At least two turns, each with a role and a value; empty values are allowed, roles aren't checked."""
    return F.coalesce((F.size(turns) >= 2) & F.forall(turns, lambda t: t.isNotNull() & t[role].isNotNull() & t["value"].isNotNull()), F.lit(False))


def valid_preference(question: Column, chosen: Column, rejected: Column) -> Column:
    return ~is_blank(question) & ~is_blank(chosen) & ~is_blank(rejected)


def valid_history(history: Column) -> Column:
    """Null, or pairs of texts throughout."""
    return history.isNull() | F.coalesce(F.forall(history, lambda t: t.isNotNull() & (F.size(t) == 2) & F.forall(t, lambda x: x.isNotNull())), F.lit(False))


def validation_report(df: DataFrame, ok: Column, order: str, lines: int = 20) -> DataFrame:
    """One row (valid, invalid, first_invalid): counts and the first faulty ordinals. The list is bounded before it is
    gathered: a third of all rows may be faulty."""
    marked = df.select(F.col(order).alias("o"), F.coalesce(ok, F.lit(False)).alias("ok"))
    first = marked.where(~F.col("ok")).select("o").orderBy("o").limit(lines).agg(F.sort_array(F.collect_list("o")).alias("first_invalid"))
    return marked.agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid")).crossJoin(first)  # one row each


def drop_reason(stages: list[tuple[str, Column]]) -> Column:
    """Name of the first stage whose condition holds, else null: later stages don't see what an earlier one drops."""
    out = None
    for name, cond in stages:
        c = F.coalesce(cond, F.lit(False))
        out = F.when(c, name) if out is None else out.when(c, name)
    return out


def first_per_flag(df: DataFrame, named: dict[str, Column], order: str, k: int) -> DataFrame:
    """Rows (flag, hits, first): hits per flag and the first k ordinals (integers). Every partition hands on at most k
    ordinals of a flag, every one of 1,024 groups of partitions again k, so no task gathers more than a few thousand
    per flag."""
    long = df.select(F.col(order).cast("long").alias("o"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))).alias("flag"))
    hits = long.groupBy("flag").agg(F.count("*").alias("hits"))

    def lowest(batches):
        best: dict[str, list[int]] = {}
        for b in batches:
            o, flag = b.column(0).to_numpy(zero_copy_only=False), np.asarray(b.column(1).to_pylist(), dtype=object)
            for f in set(flag.tolist()):
                best[f] = np.sort(np.concatenate([best.get(f, []), o[flag == f]]).astype(np.int64))[:k].tolist()
        names = [f for f, x in best.items() for _ in x]
        yield pa.RecordBatch.from_arrays([pa.array([o for x in best.values() for o in x], pa.int64()), pa.array(names, pa.string())], ["o", "flag"])

    kept = long.where("o IS NOT NULL").mapInArrow(lowest, "o long, flag string").withColumn("p", F.spark_partition_id() % 1024)
    firsts = lambda c: F.slice(F.sort_array(c), 1, k)
    some = kept.groupBy("flag", "p").agg(firsts(F.collect_list("o")).alias("some"))
    first = some.groupBy("flag").agg(firsts(F.flatten(F.collect_list("some"))).alias("first"))
    return hits.join(first, "flag")
