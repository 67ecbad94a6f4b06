"""Problem 5: held-out items inside training texts.

Rare n-gram seeds join texts to items; a Smith-Waterman alignment around the best seed scores every joined pair, and
edited copies are accepted by that score. The longest uninterrupted run of letters and digits is measured exactly.

Items may be as many as texts: their n-grams, the seeds and the pairs are tables. Texts are read
twice, however many the items: to count the items' n-grams, and to find the seeds.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import alnum_key, as_signed, batches_of, code_points, columns_of, cut, gram_hashes, gram_hashes_many, mix64, salted_join

#: Letters of a seed; items too short for it get seeds of half the length, and so on.
SEED = 8
#: Letters by which an alignment may leave its seed's diagonal to either side; gaps beyond that end it.
BAND = 64
#: Bits of the filter of the items' n-grams at most: 16 MB. It only spares rows; joins decide.
MOST_FILTER_BITS = 24
#: Score, as a share of a perfect copy's, from which a pair is an (edited) copy. A run of half an item has this much.
LEAST_SCORE = 0.5


def _half(n: int) -> int:
    return (n + 1) // 2


def _seed_size(n: int) -> int:
    q = SEED
    while q > 1 and q > _half(n):
        q //= 2
    return q


def _key(h: np.ndarray, q: int) -> np.ndarray:
    return mix64(h + np.uint64(q))


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (keys >> np.uint64(64 - bits)).astype(np.int64), (keys & mask).astype(np.int64)


def rarest_of_windows(counts: np.ndarray, width: int) -> list[int]:
    """Places of the least counts (ties: the first) of all windows of ``width`` places; linear in the number of places."""
    held: deque[int] = deque()
    out: list[int] = []
    for i, n in enumerate(counts.tolist()):
        while held and counts[held[-1]] > n:
            held.pop()
        held.append(i)
        if held[0] <= i - width:
            held.popleft()
        if i >= width - 1 and (not out or out[-1] != held[0]):
            out.append(held[0])
    return out


def longest_run(text: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Longest run of equal letters where item letter p lies on text letter p + shift."""
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if hi <= lo:
        return 0
    same = np.flatnonzero(np.concatenate(([True], text[lo + shift : hi + shift] != item[lo:hi], [True])))
    return int(np.diff(same).max() - 1)


def smith_waterman(texts: list[np.ndarray], items: list[np.ndarray], shifts: list[int], match: int = 2, mismatch: int = -1, gap: int = 1, band: int = BAND) -> np.ndarray:
    """Best local alignment score of each pair within a band around its diagonal (item letter p on text letter
    p + shift); all pairs advance together, linear gaps. Work and memory grow with the band, not with the text."""
    if not texts:
        return np.zeros(0, dtype=np.int32)
    height, width = max(map(len, items)), 2 * band + 1
    t = np.full((len(texts), height + width), -1, dtype=np.int64)  # the stretch of the text that the band can touch
    s = np.full((len(items), height), -2, dtype=np.int64)
    for k, (a, b, d) in enumerate(zip(texts, items, shifts)):
        lo, hi = max(0, d - band), min(len(a), d + len(b) + band + 1)
        if hi > lo:
            t[k, lo - (d - band) : hi - (d - band)] = a[lo:hi]
        s[k, : len(b)] = b
    ramp = np.arange(width, dtype=np.int32) * gap
    best, prev = np.zeros(len(texts), dtype=np.int32), np.zeros((len(texts), width + 1), dtype=np.int32)
    for i in range(height):  # column j is text letter i + shift + j - band
        step = np.where(t[:, i : i + width] == s[:, i : i + 1], match, mismatch).astype(np.int32)
        now = np.maximum(np.maximum(prev[:, :-1] + step, prev[:, 1:] - gap), 0)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        best = np.maximum(best, now.max(axis=1))
        prev[:, :-1] = now
    return best


def leaks(corpora: DataFrame, items: DataFrame, *, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (tbl, row_id, item_id, run, need, score): texts that hold an item or an edited copy of it.

    ``corpora`` has tbl, row_id, text. run: longest uninterrupted run of the item's letters and digits in the text
    along the seeds' diagonals; need: half of the item's; score: Smith-Waterman score around the best seed over that of
    a perfect copy, at least LEAST_SCORE. Every run of half an item is found (each quarter of an item has a seed of its
    own); of edited copies those that keep a seed. Null and empty texts match nothing, items without letters are none,
    repeated rows and item ids count once, whole texts of any length are read, an empty side gives no rows."""
    spark = corpora.sparkSession
    sc = spark.sparkContext
    rows = corpora.select("tbl", "row_id", "text").where("row_id IS NOT NULL AND text IS NOT NULL")

    def normal(batches):
        for b in batches:
            ids, texts = batches_of(b, ["item_id", "text"])
            keys = list(map(alnum_key, texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["item_id", "norm"])

    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    own = cut(own.mapInArrow(normal, "item_id long, norm string").where("norm <> ''").groupBy("item_id").agg(F.min("norm").alias("norm")))

    def grams(batches):
        for b in batches:
            ids, texts = batches_of(b, ["item_id", "norm"])
            qs, keys, at, of = [], [], [], []
            for i, t in zip(ids, texts):
                q = _seed_size(len(t))
                h = _key(gram_hashes(code_points(t), q), q)
                qs.append(np.full(len(h), q, np.int32))
                keys.append(as_signed(h))
                at.append(np.arange(len(h), dtype=np.int32))
                of.append(np.full(len(h), i, np.int64))
            flat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            yield pa.RecordBatch.from_arrays([flat(qs, pa.int32()), flat(keys, pa.int64()), flat(of, pa.int64()), flat(at, pa.int32())], ["q", "key", "item_id", "at"])

    held = cut(own.mapInArrow(grams, "q int, key long, item_id long, at int"))
    sizes = {r.q: r.n for r in held.groupBy("q").agg(F.count("*").alias("n")).collect()}  # seed lengths: at most four
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, sum(sizes.values())))), 12, MOST_FILTER_BITS))

    def filter_of(keys: DataFrame):
        """Filter of the keys, of at most 2^bits slots, and its bits."""
        bits = int(np.clip(np.ceil(np.log2(16 * max(1, keys.count()))), 12, MOST_FILTER_BITS))

        def slots(batches):
            for b in batches:
                own = np.array(b.column(0).to_numpy()).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_probes(own, bits))))], ["slot"])

        taken = np.zeros(1 << bits, dtype=bool)
        taken[columns_of(keys.mapInArrow(slots, "slot long").distinct())["slot"]] = True
        return sc.broadcast((taken, bits))

    def hits(texts: list[str], taken: np.ndarray, bits: int):
        """(row, position, key) of the texts' n-grams that pass the filter."""
        row, pos, key = [], [], []
        for q in sorted(sizes):
            r, p, h = gram_hashes_many(texts, q)
            h = _key(h, q)
            first, second = _probes(h, bits)
            ok = taken[first]
            ok[ok] = taken[second[ok]]
            row.append(r[ok])
            pos.append(p[ok])
            key.append(h[ok])
        return (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((row, np.int64), (pos, np.int64), (key, np.uint64)))

    of_items = filter_of(held.select("key"))

    def count(batches):
        for b in batches:
            _, _, key = hits(list(map(alnum_key, batches_of(b, ["text"])[0])), *of_items.value)
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(keys), pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    # First reading of the corpus: how often it has the items' n-grams.
    frequent = rows.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = held.join(frequent.hint("merge"), "key", "left")
    lists = counted.groupBy("item_id", "q").agg(F.array_sort(F.collect_list(F.struct("at", "key", F.coalesce("n", F.lit(0)).alias("n")))).alias("grams"))  # an item's own n-grams

    def rare(batches):
        for b in batches:
            out = []
            for i, q, g in zip(*batches_of(b, ["item_id", "q", "grams"])):
                counts = np.array([x["n"] for x in g])
                half = _half(len(g) + q - 1)
                width = max(1, min(len(g), max(q, half // 2) - q + 1))
                out += [(g[k]["key"], i, g[k]["at"]) for k in rarest_of_windows(counts, width) if counts[k]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["key", "item_id", "at"])

    seeds = cut(lists.mapInArrow(rare, "key long, item_id long, at int"))
    of_seeds = filter_of(seeds.select("key").distinct())

    def scan(batches):
        kind = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32())]))
        for b in batches:
            tbl, ids, raw = batches_of(b, ["tbl", "row_id", "text"])
            texts = list(map(alnum_key, raw))
            row, pos, key = hits(texts, *of_seeds.value)
            order = np.argsort(row, kind="stable")
            some, n = np.unique(row, return_counts=True)
            found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.StructArray.from_arrays([pa.array(as_signed(key[order]), pa.int64()), pa.array(pos[order].astype(np.int32))], ["key", "pos"]))
            pick = some.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([tbl[k] for k in pick], pa.string()), pa.array([ids[k] for k in pick], pa.int64()), pa.array([texts[k] for k in pick], pa.string()), found.cast(kind)], ["tbl", "row_id", "norm", "hits"])

    # Second reading: texts that hold a seed, with its places.
    met = cut(rows.mapInArrow(scan, "tbl string, row_id long, norm string, hits array<struct<key:long,pos:int>>"))
    places = met.select("tbl", "row_id", F.explode("hits").alias("h")).select("tbl", "row_id", "h.key", "h.pos")
    pairs = salted_join(places, seeds, ["key"], spread=["tbl", "row_id"]).groupBy("tbl", "row_id", "item_id").agg(F.collect_set(F.col("pos") - F.col("at")).alias("shifts"))
    pairs = pairs.join(met.select("tbl", "row_id", "norm").hint("merge"), ["tbl", "row_id"])
    pairs = salted_join(pairs, own.withColumnRenamed("norm", "item"), ["item_id"], spread=["tbl", "row_id"])

    def align(batches):
        for b in batches:
            tbl, ids, of, shifts, texts, wanted = batches_of(b, ["tbl", "row_id", "item_id", "shifts", "norm", "item"])
            texts, wanted = list(map(code_points, texts)), list(map(code_points, wanted))
            found = [max((longest_run(t, i, d), d) for d in ds) for t, i, ds in zip(texts, wanted, shifts)]
            score = np.zeros(len(found))
            order = np.argsort([len(i) for i in wanted], kind="stable")
            for k in range(0, len(order), 256):
                part = order[k : k + 256].tolist()
                got = smith_waterman([texts[j] for j in part], [wanted[j] for j in part], [found[j][1] for j in part])
                score[part] = got / (2.0 * np.array([len(wanted[j]) for j in part]))
            yield pa.RecordBatch.from_arrays([pa.array(tbl, pa.string()), pa.array(ids, pa.int64()), pa.array(of, pa.int64()), pa.array([r for r, _ in found], pa.int32()), pa.array([_half(len(i)) for i in wanted], pa.int32()), pa.array(score)], ["tbl", "row_id", "item_id", "run", "need", "score"])

    aligned = pairs.select("tbl", "row_id", "item_id", "shifts", "norm", "item").mapInArrow(align, "tbl string, row_id long, item_id long, run int, need int, score double")
    return aligned.where(F.col("score") >= LEAST_SCORE).dropDuplicates(["tbl", "row_id", "item_id"])
