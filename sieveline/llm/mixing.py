"""Problem 8: mixing sources to target weights.

Iterative proportional fitting rakes the tokens of cells (source, language, topic) to the target shares of the
sources and to the corpus's own shares of languages and topics; no cell may pass its source's cap of repeats. Documents
then enter by the calibrated number of repeats of their cell: its whole part always, its fraction for the documents of
lowest hash until the source's tokens are reached.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Rounds of fitting at most (it ends when the margins hold), intervals into which hashes are cut, and how often the
#: interval of the last document is cut again.
ROUNDS, INTERVALS, LEVELS = 200, 4096, 3


def rake(cells: dict[tuple[str, str, str], float], shares: dict[str, float], caps: dict[str, int], budget: float) -> tuple[dict[tuple[str, str, str], float], float]:
    """(repeats of each cell, tokens of the mixture): source shares are met exactly, languages and topics as nearly as
    the caps let them. Where a source is too small for its share of the budget even at its cap, the mixture is smaller."""
    by_source = defaultdict(float)
    for (s, _, _), n in cells.items():
        by_source[s] += n
    wanted = {s: x for s, x in shares.items() if x > 0 and by_source.get(s, 0) > 0 and caps[s] > 0}  # others can't be met
    if not wanted:
        return {}, 0.0
    norm = sum(wanted.values())
    wanted = {s: x / norm for s, x in wanted.items()}
    total = min([budget, *(caps[s] * by_source[s] / x for s, x in wanted.items())])
    keys = sorted(k for k in cells if k[0] in wanted and cells[k] > 0)
    have = np.array([cells[k] for k in keys])
    most = have * np.array([caps[k[0]] for k in keys])
    x = have * (total / have.sum())
    targets = []
    for axis in (1, 2, 0):
        names = sorted({k[axis] for k in keys})
        at = np.array([names.index(k[axis]) for k in keys])
        if axis == 0:
            goal = np.array([wanted[s] * total for s in names])
        else:
            goal = np.bincount(at, weights=have, minlength=len(names))
            goal *= total / goal.sum()
        targets.append((at, goal))
    for _ in range(ROUNDS):
        old = x
        for at, goal in targets:  # the sources last
            now = np.bincount(at, weights=x, minlength=len(goal))
            x = np.minimum(x * (goal / np.maximum(now, 1e-12))[at], most)
        if np.abs(x - old).max() <= 1e-9 * total:
            break
    at, goal = targets[2]
    for _ in range(ROUNDS):  # caps can leave a source short: what is free takes the rest
        now = np.bincount(at, weights=x, minlength=len(goal))
        short = goal - now
        if np.all(short <= 1e-6 * goal):
            break
        free = np.where(x < most - 1e-9, np.maximum(x, 1e-9 * have), 0.0)
        base = np.bincount(at, weights=free, minlength=len(goal))
        x = np.minimum(x + free * np.where(base > 0, np.maximum(short, 0) / np.maximum(base, 1e-12), 0.0)[at], most)
    return {k: float(v / h) for k, v, h in zip(keys, x, have)}, float(total)


def mix(documents: DataFrame, targets: DataFrame, *, seed: int = 0) -> DataFrame:
    """Rows (mix_id, doc_id, source, tokens, repeats) of documents (doc_id, source, lang, topic, tokens) and targets
    (mix_id, source, target_share, max_repeats, budget_ratio): the documents of each mixture and how often they come.

    A source has its own max_repeats (the least, where it is named twice). Documents of null or non-positive tokens,
    null ids and sources that a mixture doesn't name are left out; an id given twice counts once; null languages and
    topics are classes of their own; the number of mixtures, sources, languages and topics is small (they are fetched),
    that of documents is not bounded. Empty tables give no rows."""
    spark = documents.sparkSession
    docs = documents.where("doc_id IS NOT NULL AND tokens > 0").dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("topic", F.lit("")).alias("topic"), "tokens", (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("h"))
    docs = cut(docs)
    cells = {(r.source, r.lang, r.topic): float(r.n) for r in docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("n")).collect()}
    corpus = sum(cells.values())
    plans, need = [], defaultdict(float)
    for m, rows in _by_mix(targets).items():
        caps: dict[str, int] = {}
        for r in rows:
            caps[r.source] = min(caps.get(r.source, int(r.max_repeats)), int(r.max_repeats))
        repeats, _ = rake(cells, {r.source: float(r.target_share) for r in rows}, caps, float(rows[0].budget_ratio) * corpus)
        for (s, lang, topic), w in repeats.items():
            whole = min(int(w + 1e-12), caps[s])
            part = float(max(0.0, w - whole)) if whole < caps[s] else 0.0
            plans.append((m, s, lang, topic, whole, part))
            need[m, s] += part * cells[s, lang, topic]
    # Plans and limits have a row per mixture and cell, or source: bounded by the few classes, whatever the documents.
    planned = spark.createDataFrame(plans, "mix_id int, source string, lang string, topic string, whole int, part double")
    joined = docs.join(F.broadcast(planned), ["source", "lang", "topic"])
    # The fraction of a source's cells: documents in order of a hash scaled by the fraction, until the tokens are met. The
    # place where they are met is found by histograms: each level cuts the interval that holds it into INTERVALS again.
    scaled = joined.withColumn("u", F.when(F.col("part") > 0, F.col("h") / F.col("part")))
    scaled = scaled.withColumn("v", F.col("u") / (F.col("u") + 1))  # from 0 to below 1, in the same order
    low, width, left = {k: 0.0 for k in need}, 1.0, dict(need)
    for _ in range(LEVELS):
        limits = spark.createDataFrame([(m, s, low[m, s]) for m, s in need], "mix_id int, source string, low double")
        slot = F.floor((F.col("v") - F.col("low")) / F.lit(width) * INTERVALS)
        inside = scaled.where("v IS NOT NULL").join(F.broadcast(limits), ["mix_id", "source"]).withColumn("slot", slot).where((F.col("slot") >= 0) & (F.col("slot") < INTERVALS))
        sums: dict = defaultdict(dict)
        for r in inside.groupBy("mix_id", "source", "slot").agg(F.sum("tokens").alias("n")).collect():  # mixtures x sources x INTERVALS
            sums[r.mix_id, r.source][r.slot] = float(r.n)
        width /= INTERVALS
        for k in need:
            at = 0
            for at in sorted(sums[k]):
                if sums[k][at] > left[k]:
                    break
                left[k] -= sums[k][at]
            else:
                at += 1
            low[k] += at * width
    # What is left within the last interval, a 2^-36th of the hashes: all of it or nothing, whichever is nearer.
    ends = []
    for m, s in need:
        rest = sums[m, s].get(int(round((low[m, s] % (width * INTERVALS)) / width)), 0.0)
        ends.append((m, s, low[m, s] + (width if rest and rest / 2 <= left[m, s] else 0.0)))
    limits = spark.createDataFrame(ends, "mix_id int, source string, last double")
    withl = scaled.join(F.broadcast(limits), ["mix_id", "source"], "left")
    extra = F.coalesce((F.col("v") < F.col("last")).cast("int"), F.lit(0))
    return withl.withColumn("repeats", (F.col("whole") + extra).cast("int")).where("repeats > 0").select("mix_id", "doc_id", "source", "tokens", "repeats")


def _by_mix(targets: DataFrame) -> dict:
    out = defaultdict(list)
    for r in targets.where("mix_id IS NOT NULL AND source IS NOT NULL AND target_share IS NOT NULL").select("mix_id", "source", "target_share", "max_repeats", "budget_ratio").collect():
        out[r.mix_id].append(r)
    return {m: sorted(rows, key=lambda r: r.source) for m, rows in sorted(out.items())}


def shares(mixed: DataFrame, targets: DataFrame, corpus_tokens: DataFrame) -> DataFrame:
    """Rows (mix_id, source, target_share, max_repeats, documents, repeats, tokens, actual_share, source_tokens, budget,
    mixture_tokens, shortfall): of every source of every mixture. ``corpus_tokens``: rows (source, tokens) of the
    corpus. budget: the tokens that the mixture should have; shortfall: the share of it that it lacks, because a source
    is too small for its share even at its cap."""
    per = mixed.groupBy("mix_id", "source").agg(F.count("*").alias("documents"), F.sum("repeats").alias("repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    total = mixed.groupBy("mix_id").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixture_tokens"))
    held = corpus_tokens.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("tokens").alias("source_tokens"))
    corpus = held.agg(F.sum("source_tokens").alias("corpus"))
    t = targets.select("mix_id", "source", "target_share", "max_repeats", "budget_ratio").join(per, ["mix_id", "source"], "left").join(total, "mix_id", "left").join(held, "source", "left")
    t = t.fillna(0, ["documents", "repeats", "tokens", "mixture_tokens", "source_tokens"]).crossJoin(corpus)  # one row
    t = t.withColumn("budget", F.col("budget_ratio") * F.col("corpus")).withColumn("actual_share", F.when(F.col("mixture_tokens") > 0, F.col("tokens") / F.col("mixture_tokens")).otherwise(0.0))
    return t.withColumn("shortfall", F.when(F.col("budget") > 0, F.greatest(F.lit(0.0), 1 - F.col("mixture_tokens") / F.col("budget"))).otherwise(0.0)).select("mix_id", "source", "target_share", "max_repeats", "documents", "repeats", "tokens", "actual_share", "source_tokens", "budget", "mixture_tokens", "shortfall")
