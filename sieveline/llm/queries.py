"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crosssplit import cross_split, overlap_classes, overlap_counts, overlap_pairs
from .formatdup import format_duplicates
from .garble import garbled
from .leak import leaks
from .mixing import mix, shares
from .packing import fill, pack
from .pairs import pair_defects
from .pii import personal_information
from .sentences import split_sentences
from .shared import cut, table
from .tokens import count_tokens
from .topics import with_topics


def _texts(spark: SparkSession, d: str, *parts: tuple[str, str, str]) -> DataFrame:
    """(tbl, row_id, text) of the given (table, id, column)."""
    out = None
    for name, key, column in parts:
        part = table(spark, d, name).select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"), F.col(column).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def _free_texts(spark, d):
    return _texts(spark, d, ("documents", "doc_id", "text"), ("sft_raw", "record_id", "output"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(_free_texts(spark, d)).select("tbl", "row_id")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled(_free_texts(spark, d))


_FORMS = (("sft_raw", "record_id", ["instruction", "input", "output"], False), ("pref_raw", "pref_id", ["question", "response_chosen", "response_rejected"], False), ("raw_lines", "line_id", ["payload"], True))


def _copies(spark, d):
    out = None
    for name, key, fields, payload in _FORMS:
        part = format_duplicates(table(spark, d, name), key, fields, payload=payload).select(F.lit(name).alias("tbl"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).where("id <> keep_id").select("tbl", "keep_id", F.col("id").alias("copy_id"))


def p2_copy_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row per group of copies: the record that stays and how many copies there are."""
    return _copies(spark, d).where("id = keep_id").select("tbl", "keep_id", "copies")


def _pairs(spark, d):
    sft = table(spark, d, "sft_raw").select(F.lit("sft_raw").alias("tbl"), F.col("record_id").alias("row_id"), F.lit("output").alias("field_name"), F.col("instruction").alias("question"), F.col("output").alias("answer"))
    pref = table(spark, d, "pref_raw").select(F.lit("pref_raw").alias("tbl"), F.col("pref_id").alias("row_id"), F.expr("stack(2, 'response_chosen', response_chosen, 'response_rejected', response_rejected)").alias("field_name", "answer"), F.col("question"))
    return sft.unionByName(pref)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects(_pairs(spark, d)).select("tbl", "row_id", "field_name", "defect")


def p3_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects(_pairs(spark, d)).groupBy("tbl", "field_name", "defect").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(_free_texts(spark, d)).select("tbl", "row_id", F.explode("mentions").alias("m")).select("tbl", "row_id", "m.kind", "m.start_at")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(_free_texts(spark, d)).select("tbl", "row_id", "redacted")


def _items(spark, d):
    return table(spark, d, "mcq").select("item_id", F.col("question").alias("text")).unionByName(table(spark, d, "heldout_texts").select("item_id", "text"))


def _leaks(spark, d):
    return leaks(_texts(spark, d, ("documents", "doc_id", "text"), ("sft_raw", "record_id", "instruction")), _items(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that the alignment accepts and whose uninterrupted run is exactly long enough."""
    return _leaks(spark, d).where("run >= need").select("tbl", "row_id", "item_id")


def p5_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Every text that holds an item or an edited copy of one, by alignment score, with the longest run."""
    return _leaks(spark, d)


def _turns(spark, d):
    chat = table(spark, d, "sft_chat").select(F.lit("sft_chat").alias("tbl"), F.col("conv_id").alias("id"), "split", "source", F.explode("conversations").alias("turn"))
    chat = chat.where(F.col("turn.role").isin("human", "user")).select("tbl", "id", "split", "source", F.col("turn.value").alias("text"))
    return chat.unionByName(table(spark, d, "pref_raw").select(F.lit("pref_raw").alias("tbl"), F.col("pref_id").alias("id"), "split", "source", F.col("question").alias("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap_pairs(*cross_split(_turns(spark, d)))
    return pairs.select("tbl", F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).where("id_a < id_b").distinct()


def p6_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap_counts(*cross_split(_turns(spark, d)))


def p6_overlap_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap_classes(*cross_split(_turns(spark, d)))


def _lengths(spark, d):
    return count_tokens(table(spark, d, "documents").select("doc_id", "text"))


def _mixable(spark, d):
    """Documents with source, language, topic and tokens, counted once."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.lower(F.trim("lang")).alias("lang"), "text")
    return cut(count_tokens(with_topics(docs, of=docs)))


def _packed(spark, d, finish):
    """The documents packed for every row of pack_limits, whose few rows are fetched."""
    items = cut(_lengths(spark, d).select(F.col("doc_id").alias("id"), F.col("tokens").alias("length")))
    out = None
    for r in table(spark, d, "pack_limits").orderBy("pack_id").collect():
        part = finish(pack(items, r.capacity_tokens, r.sep_tokens), r).withColumn("pack_id", F.lit(r.pack_id))
        out = part if out is None else out.unionByName(part)
    return out


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, lambda placed, _: placed).select("pack_id", F.col("id").alias("doc_id"), "part", F.col("length").alias("tokens"), "container", "place")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, lambda placed, r: fill(placed, r.capacity_tokens, r.sep_tokens).withColumn("capacity_tokens", F.lit(r.capacity_tokens)))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_mixable(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets, docs = table(spark, d, "mix_targets"), _mixable(spark, d)
    return shares(mix(docs, targets), targets, docs.select("source", "tokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    wrong = garbled(_free_texts(spark, d)).where("tbl = 'documents'").select(F.col("row_id").alias("doc_id"))
    return split_sentences(docs.join(wrong, "doc_id", "left_anti")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return {k: v for k, v in SQL.items() if k in queries()}
