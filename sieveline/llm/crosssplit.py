"""Problem 6: the same or almost the same texts in a training split and in evaluation splits.

Texts are reduced to letters and digits and to one row per distinct text. Of each evaluation text so many disjoint rare
n-grams are taken that edits can't touch all; their hashes are partitioned and met by those of training texts, which
are scanned once. Containment decides which pairs go on: as an edit touches one of the n-grams at most, a known number
of them must be in the training text, each at a place that the edits allow. The edit distance is an exact check of what
is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import alnum_key, as_signed, batches_of, columns_of, cut, gram_hashes_many, mix64, salted_join

#: Letters of an n-gram, n-grams beyond those that edits may touch (fewer in texts too short for them), and letters over
#: which the choice of n-grams is weighed together.
WINDOW, SPARE, BLOCK = 6, 2, 512
#: Counters of the sketch of n-gram frequencies (2 MB), bits of the filter of taken n-grams at most (16 MB).
SKETCH_BITS, MOST_FILTER_BITS = 19, 24
#: Rows of an n-gram (by the sketch) that one task takes.
HOT = 20_000


def edits_allowed(n: int, share: float) -> int:
    """Edits that a text of n letters may have against the longest text that can still match it."""
    return int(share * int(n / (1 - share)) + 1e-9)


def windows_wanted(n: int, share: float) -> tuple[int, int]:
    """(n-grams taken of a text of n letters, how many of them must be in a text near enough)."""
    edits = edits_allowed(n, share)
    wanted = min(edits + 1 + SPARE, n // WINDOW)
    if wanted <= edits:
        raise ValueError("the text is too short for that many n-grams")
    return wanted, wanted - edits


def rarest_windows(cost: np.ndarray, wanted: int) -> np.ndarray:
    """Starts of ``wanted`` disjoint n-grams of least total cost; cost[i] is that of the n-gram that starts at i. An
    edit touches at most one of them. Texts beyond BLOCK letters are cut into blocks that share the number out, so
    work and memory grow with the text."""
    n = len(cost) + WINDOW - 1
    if n > BLOCK:
        blocks = -(-n // BLOCK)
        edges = np.arange(blocks + 1) * n // blocks
        own = np.diff(np.arange(blocks + 1) * wanted // blocks)
        if all(k * WINDOW <= z - a for k, a, z in zip(own, edges[:-1], edges[1:])):
            return np.concatenate([a + rarest_windows(cost[a : z - WINDOW + 1], int(k)) for k, a, z in zip(own, edges[:-1], edges[1:])])
    big = np.int64(1) << 50
    best = np.full((n + 1, wanted + 1), big, dtype=np.int64)  # best[i, j]: j n-grams among the first i letters
    best[:, 0] = 0
    took = np.zeros((n + 1, wanted + 1), dtype=bool)
    for i in range(WINDOW, n + 1):
        with_last = best[i - WINDOW, :-1] + cost[i - WINDOW]
        took[i, 1:] = with_last < best[i - 1, 1:]
        best[i, 1:] = np.where(took[i, 1:], with_last, best[i - 1, 1:])
    out, i, j = [], n, wanted
    while j:
        if took[i, j]:
            out.append(i - WINDOW)
            i, j = i - WINDOW, j - 1
        else:
            i -= 1
    return np.array(out[::-1], dtype=np.int64)


def table_salt(tbl: str) -> int:
    return xxhash.xxh3_64_intdigest(tbl.encode())


def met_by(h: np.ndarray, part: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One number by which n-grams meet: of the same letters, part and table. What else falls together by chance is parted
    by the table, the places and the edit distance."""
    return mix64(h ^ mix64(salt + part.astype(np.uint64)))


def _keyed(batches):
    for b in batches:
        names = ["tbl", "id", "split", "source"]
        cols, texts = batches_of(b, names), [alnum_key(t) for t in batches_of(b, ["text"])[0]]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64() if n == "id" else pa.string()) for n, c in zip(names, cols)), pa.array([xxhash.xxh3_128_digest(t.encode()) for t in texts], pa.binary()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int32())],
            [*names, "key", "norm", "n"],
        )


def cross_split(texts: DataFrame, *, train: str = "train", share: float = 0.08, shortest: int = 20) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts (tbl, id, split, source, text).

    members: (tbl, key, id, split, source), key standing for all texts of the same letters and digits. links:
    (tbl, eval_key, train_key, edits, containment) between different texts of an evaluation split and of ``train``
    that differ in at most ``share`` of the longer one's letters and digits; no link is dropped. containment: the share of
    the evaluation text's taken n-grams that the training text has. Texts under ``shortest`` letters and digits (which
    must leave room for the n-grams, see windows_wanted), null ids and null splits take no part; an empty table gives empty results."""
    spark = texts.sparkSession
    keyed = texts.where("id IS NOT NULL AND split IS NOT NULL AND text IS NOT NULL").select("tbl", "id", "split", "source", "text").mapInArrow(_keyed, "tbl string, id long, split string, source string, key binary, norm string, n int")
    keyed = keyed.where(F.col("n") >= shortest)
    members = keyed.select("tbl", "key", "id", "split", "source").distinct()
    is_train = F.col("split") == train
    distinct = cut(keyed.groupBy("tbl", "key").agg(F.max(is_train).alias("in_train"), F.max(~is_train).alias("in_eval"), F.first("norm").alias("norm"), F.first("n").alias("n")).withColumn("u", F.monotonically_increasing_id()))  # u stands for (tbl, key) in narrow rows

    def sketch(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            _, _, h = gram_hashes_many(batches_of(b, ["norm"])[0], WINDOW)
            total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["slot", "n"])

    # At most 2^SKETCH_BITS rows. The sketch only steers which n-grams are taken; no choice of them loses a pair.
    slots = columns_of(distinct.select("norm").mapInArrow(sketch, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    counts[slots["slot"]] = np.minimum(slots["n"], 2**31 - 1)
    counts = spark.sparkContext.broadcast(counts)

    def chosen(batches):
        for b in batches:
            tbl, u, norm = batches_of(b, ["tbl", "u", "norm"])
            row, pos, h = gram_hashes_many(norm, WINDOW)
            cost = counts.value[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            ends = np.cumsum(np.bincount(row, minlength=len(norm)))
            rows, at, needs, wants = [], [], [], []
            for i, t in enumerate(norm):
                wanted, need = windows_wanted(len(t), share)
                lo = int(ends[i - 1]) if i else 0
                at.append(lo + rarest_windows(cost[lo : int(ends[i])], wanted))
                rows += [i] * wanted
                needs += [need] * wanted
                wants += [wanted] * wanted
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            # A hot n-gram is met in several parts: the training rows of each lie in one of them.
            parts = 1 + cost[at] // HOT
            rows, needs, wants = (np.repeat(np.array(x, dtype=t), parts) for x, t in ((rows, np.int64), (needs, np.int32), (wants, np.int32)))
            part = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
            at = np.repeat(at, parts)
            n = np.array(list(map(len, norm)), dtype=np.int64)
            meet = met_by(h[at], part, np.array([table_salt(t) for t in tbl], dtype=np.uint64)[rows])
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(x)) if x.dtype == np.uint64 else pa.array(x) for x in (h[at], meet, np.array(u, dtype=np.int64)[rows], n[rows] << 32 | pos[at], wants.astype(np.int64) << 32 | needs)], ["gram", "meet", "e", "place_e", "counts"])

    left = cut(distinct.where("in_eval").select("tbl", "u", "norm").mapInArrow(chosen, "gram long, meet long, e long, place_e long, counts long"))
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, left.count()))), 12, MOST_FILTER_BITS))

    def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)

    def taken(batches):
        for b in batches:
            h = np.array(b.column(0).to_numpy()).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(probes(h))))], ["bit"])

    # At most 2^bits rows: training n-grams that no evaluation text has taken never leave their task.
    held = np.zeros(1 << bits, dtype=bool)
    held[columns_of(left.select("gram").mapInArrow(taken, "bit long").distinct())["bit"]] = True
    held = spark.sparkContext.broadcast(held)

    def windows(batches):
        for b in batches:
            tbl, u, norm = batches_of(b, ["tbl", "u", "norm"])
            row, pos, h = gram_hashes_many(norm, WINDOW)
            first, second = probes(h)
            ok = held.value[first]
            ok[ok] = held.value[second[ok]]
            row, pos, h = row[ok], pos[ok], h[ok]
            parts = 1 + counts.value[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] // HOT
            u, n = np.array(u, dtype=np.int64), np.array(list(map(len, norm)), dtype=np.int64)
            part = mix64(u.astype(np.uint64))[row] % parts.astype(np.uint64)
            meet = met_by(h, part, np.array([table_salt(t) for t in tbl], dtype=np.uint64)[row])
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(meet)), pa.array(u[row]), pa.array(n[row] << 32 | pos)], ["meet", "t", "place_t"])

    right = distinct.where("in_train").select("tbl", "u", "norm").mapInArrow(windows, "meet long, t long, place_t long")
    low = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1))
    most = F.floor(F.greatest(F.shiftright("place_e", 32), F.shiftright("place_t", 32)) * share + 1e-9)
    near = (F.abs(F.shiftright("place_e", 32) - F.shiftright("place_t", 32)) <= most) & (F.abs(low("place_e") - low("place_t")) <= most) & (F.col("e") != F.col("t"))
    met = left.select("meet", "e", "place_e", "counts").join(right.hint("merge"), "meet").where(near)
    # A training text that has an n-gram twice within reach counts it once.
    pairs = met.groupBy("e", "t").agg(F.size(F.collect_set(low("place_e").cast("int"))).alias("held"), F.first("counts").alias("counts")).where(F.col("held") >= low("counts"))
    pairs = pairs.select("e", "t", (F.col("held") / F.shiftright("counts", 32)).alias("containment"))
    e = distinct.where("in_eval").select("tbl", F.col("u").alias("e"), F.col("key").alias("eval_key"), F.col("norm").alias("a"))
    t = distinct.where("in_train").select("tbl", F.col("u").alias("t"), F.col("key").alias("train_key"), F.col("norm").alias("b"))
    pairs = pairs.join(e.hint("merge"), "e").join(t.hint("merge"), ["tbl", "t"])
    pairs = pairs.withColumn("most", F.floor(F.greatest(F.length("a"), F.length("b")) * share + 1e-9).cast("int"))
    links = pairs.withColumn("edits", F.expr("levenshtein(a, b, most)")).where("edits >= 0")
    return members, links.select("tbl", "eval_key", "train_key", "edits", "containment")


def overlap_classes(members: DataFrame, links: DataFrame, *, train: str = "train") -> DataFrame:
    """Rows (tbl, class_id, split, records, exact, near): every class of equal texts of an evaluation split that overlaps
    with training, by its smallest record; how many records of the split it stands for, how many training records are
    equal, and how many different training texts are almost equal. Copies aren't expanded into pairs."""
    e = members.where(F.col("split") != train).groupBy("tbl", "key", "split").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("records")).withColumnRenamed("key", "eval_key")
    exact = members.where(F.col("split") == train).groupBy("tbl", F.col("key").alias("eval_key")).agg(F.countDistinct("id").alias("exact"))
    near = links.groupBy("tbl", "eval_key").agg(F.countDistinct("train_key").alias("near"))
    out = e.join(exact.hint("merge"), ["tbl", "eval_key"], "left").join(near.hint("merge"), ["tbl", "eval_key"], "left").fillna(0, ["exact", "near"])
    return out.where("exact + near > 0").select("tbl", "class_id", "split", "records", "exact", "near")


def overlap_pairs(members: DataFrame, links: DataFrame, *, train: str = "train") -> DataFrame:
    """Rows (tbl, train_id, eval_id, split, source): every overlap, expanded from the texts to their records."""
    t = members.where(F.col("split") == train).select("tbl", F.col("key").alias("train_key"), F.col("id").alias("train_id"))
    e = members.where(F.col("split") != train).select("tbl", F.col("key").alias("eval_key"), F.col("id").alias("eval_id"), "split", "source")
    same = e.select("tbl", "eval_key", F.col("eval_key").alias("train_key")).distinct()
    linked = salted_join(t, links.select("tbl", "eval_key", "train_key").unionByName(same), ["tbl", "train_key"], spread=["train_id"])
    return salted_join(linked.select("tbl", "eval_key", "train_id"), e, ["tbl", "eval_key"], spread=["train_id"]).select("tbl", "train_id", "eval_id", "split", "source").distinct()


def overlap_counts(members: DataFrame, links: DataFrame, *, train: str = "train") -> DataFrame:
    """Rows (tbl, split, source, records, exact, near): evaluation records per split and source, and how many of them
    have an equal or an almost equal training text. Copies are counted, never expanded into pairs."""
    in_train = members.where(F.col("split") == train).select("tbl", F.col("key").alias("eval_key")).distinct().withColumn("is_exact", F.lit(1))
    near = links.select("tbl", "eval_key").distinct().withColumn("is_near", F.lit(1))
    e = members.where(F.col("split") != train).withColumnRenamed("key", "eval_key").join(in_train, ["tbl", "eval_key"], "left").join(near, ["tbl", "eval_key"], "left")
    per = e.groupBy("tbl", "id", "split", "source").agg(F.max("is_exact").alias("x"), F.max("is_near").alias("m"))
    return per.groupBy("tbl", "split", "source").agg(F.count("*").alias("records"), F.count("x").alias("exact"), F.count("m").alias("near"))
