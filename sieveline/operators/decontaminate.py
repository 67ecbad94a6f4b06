"""Overlap of a corpus with held-out sets and benchmarks, as salted joins on digests and a seeded substring search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import gram_filter, gram_rows
from ..session import cut_lineage
from .dedup import digest
from .joins import salted_join


def overlap_flag(df: DataFrame, key: Column, other: DataFrame, other_key: Column, name: str, *, salts: int = 16) -> DataFrame:
    """The rows with a boolean ``name``: whether their key is among the other side's. Empty and null keys match nothing.
    The other side is reduced to distinct digests; a key of a third of all rows is spread over ``salts`` tasks."""
    keys = other.where(other_key != "").select(digest(other_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    left = df.withColumn("_k", F.when(key != "", digest(key)))
    return salted_join(left, keys, ["_k"], "left", salts=salts).withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def substring_hits(docs: DataFrame, doc_id: str, text: Column, items: DataFrame, item_id: str, item_text: Column, *, seed: int = 8) -> DataFrame:
    """Rows (doc_id, item_id): items whose whole normalised text lies within a document's.

    Documents offer the distinct n-grams of ``seed`` letters that any item has; every item is met by the one of its
    own that fewest documents have, and texts are fetched only for the pairs that meet; ``contains`` decides. Items
    shorter than the seed are met by n-grams of their own length. Null and empty texts match nothing."""
    d = docs.select(F.col(doc_id).alias("doc_id"), text.alias("t")).where("t IS NOT NULL AND t <> ''")
    i = items.select(F.col(item_id).alias("item_id"), item_text.alias("s")).where("s IS NOT NULL AND s <> ''").distinct()
    met = None
    for q in _seed_lengths(i, seed):
        own = i.where(F.length("s") >= seed if q == seed else F.length("s") == q)
        own = own.withColumn("sid", F.xxhash64("item_id", "s"))
        own = cut_lineage(gram_rows(own, "sid", "s", q).join(own, "sid").drop("sid"))
        # One row per document and shared n-gram, without its text; a filter of fixed size keeps most others in their task.
        offered = gram_rows(d, "doc_id", "t", q, only=gram_filter(own, "g"))
        shared = cut_lineage(salted_join(offered, own.select("g").distinct(), ["g"], "left_semi"))
        held = own.join(shared.groupBy("g").agg(F.count("*").alias("n")), "g", "left")
        rarest = held.groupBy("item_id", "s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).where("m.n > 0")
        by_gram = rarest.groupBy(F.col("m.g").alias("g")).agg(F.collect_list(F.struct("item_id", "s")).alias("items"))  # bounded by the items
        hits = salted_join(shared, by_gram, ["g"]).select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.item_id", "x.s")
        met = hits if met is None else met.unionByName(hits)
    if met is None:
        return d.select("doc_id").limit(0).crossJoin(i.select("item_id").limit(0))  # both empty
    return met.distinct().join(d, "doc_id").where(F.contains("t", "s")).select("doc_id", "item_id").distinct()


def _seed_lengths(items: DataFrame, seed: int) -> list[int]:
    """The n-gram lengths that the items need: at most ``seed`` numbers."""
    found = items.select(F.least(F.length("s"), F.lit(seed)).alias("q")).distinct().collect()
    return sorted(r.q for r in found)

