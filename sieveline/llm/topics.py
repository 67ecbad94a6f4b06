"""Topics of texts by spherical k-means over hashed words, fitted on all texts.

Sparse vectors are stored once, compressed; every seed and every round of k-means reads all of them. Only sums by bucket,
of a size that the topics, languages and buckets bound, reach the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import CLASS, FOLD, HAN, KANA, THAI, Block, chunks
from .shared import cut, mix64

#: Topics, buckets of the hashed words, and rounds at most; texts that are laid out at once.
TOPICS, BUCKETS, ROUNDS, AT_ONCE = 8, 2048, 30, 500


def vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors of the texts: logarithms of how often hashed words (pairs of letters where words aren't spaced)
    occur. A text without letters is a vector of zeros."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for lo, hi in chunks(list(map(len, texts))):
        block = Block(texts[lo:hi])
        classes, folded = CLASS(block.codes), FOLD(block.codes).astype(np.uint64)
        letter = classes > 0
        joined = np.isin(classes, (HAN, KANA, THAI))
        both = letter[:-1] & letter[1:] & joined[:-1] & joined[1:]
        at = np.flatnonzero(both)
        h, row = [mix64((folded[at] << np.uint64(21)) | folded[at + 1])], [block.row[at]]
        word = letter & ~joined
        first = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
        if len(first):
            end = np.flatnonzero(word & ~np.concatenate((word[1:], [False]))) + 1
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(folded + np.uint64(1)), dtype=np.uint64)))
            h.append(mix64((sums[end] - sums[first]) + (end - first).astype(np.uint64)))
            row.append(block.row[first])
        h, row = np.concatenate(h), np.concatenate(row)
        n = np.bincount(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
        out[lo:hi] = np.log1p(n)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def _store(batches):
    """Batches (doc_id, lang, text) as blobs of sparse vectors: of each text its id, language and number of buckets."""
    for b in batches:
        ids, langs, texts = (b.column(k).to_pylist() for k in range(3))
        for lo in range(0, len(ids), AT_ONCE):
            x = vectors(texts[lo : lo + AT_ONCE])
            row, bucket = np.nonzero(x)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(x)))).astype(np.int32)), pa.array(bucket.astype(np.int16)))
            weights = pa.ListArray.from_arrays(lists.offsets, pa.array(x[row, bucket]))
            part = pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + AT_ONCE], pa.int64()), pa.array([lang or "" for lang in langs[lo : lo + AT_ONCE]]), lists, weights], ["id", "lang", "bucket", "weight"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["blob"])


def _stored(batches):
    """(ids, languages, row, bucket, weight) of the stored texts that have letters."""
    for b in batches:
        for blob in b.column(0):
            x = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
            n = np.diff(x.column(2).offsets.to_numpy())
            some = np.flatnonzero(n)
            langs = np.array(x.column(1).to_pylist(), dtype=object)[some]
            yield x.column(0).to_numpy()[some], langs, np.repeat(np.arange(len(some)), n[some]), x.column(2).flatten().to_numpy(), x.column(3).flatten().to_numpy().astype(np.float64)


def _sums(store: DataFrame, count) -> list:
    """What ``count`` adds up over the stored texts, {(group, place): number}, summed over all tasks."""

    def run(batches):
        total: dict = {}
        for part in _stored(batches):
            for group, values in count(*part).items():
                total[group] = total[group] + values if group in total else values
        groups, places, values = [], [], []
        for group, v in total.items():
            at = np.flatnonzero(v)
            groups += [group] * len(at)
            places.append(at)
            values.append(v[at])
        flat = lambda x: np.concatenate(x) if x else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(flat(places).astype(np.int64)), pa.array(flat(values).astype(np.float64))], ["g", "place", "n"])

    return store.mapInArrow(run, "g string, place long, n double").groupBy("g", "place").agg(F.sum("n").alias("n")).collect()


class _Model:
    """Weights of the buckets and the mean vector of each language; places texts by centres."""

    def __init__(self, idf: np.ndarray, means: dict[str, np.ndarray]):
        self.idf, self.means = idf, means

    def similarities(self, centres, langs, row, bucket, weight) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x centres, weights of the buckets, norms) of sparse texts without their language's mean."""
        w, n = weight * self.idf[bucket], len(langs)
        names, of = np.unique(langs.astype(str), return_inverse=True)
        means = np.stack([self.means[k] for k in names])
        add = lambda v: np.bincount(row, v, minlength=n)
        norm = np.sqrt(np.maximum(add(w * w) - 2 * add(w * means[of[row], bucket]) + (means * means).sum(axis=1)[of], 0))
        norm = np.maximum(norm, 1e-9)
        sims = np.stack([add(w * c[bucket]) for c in centres], axis=1) - (means @ centres.T)[of]
        return sims / norm[:, None], w, norm


def fit(texts: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """(weights of the buckets, mean vector of each language, centres) of all texts (doc_id, lang, text). Means are taken
    away, so that topics cut across languages as far as words allow, instead of repeating them. Seeds are drawn among all
    texts by the square of their distance from those before, by a hash of their ids."""
    store = cut(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(_store, "blob binary"))

    def frequencies(ids, langs, row, bucket, weight):
        out = {"n": np.array([float(len(ids))]), "df": np.bincount(bucket, minlength=BUCKETS).astype(float)}
        for lang in set(langs):
            of = langs == lang
            own = of[row]
            out["x" + lang] = np.append(np.bincount(bucket[own], weight[own], minlength=BUCKETS), of.sum())
        return out

    total: dict[str, np.ndarray] = {}
    for r in _sums(store, frequencies):
        total.setdefault(r.g, np.zeros(BUCKETS + 1))[r.place] = r.n
    if "n" not in total:
        return np.zeros(BUCKETS, np.float32), {}, np.zeros((1, BUCKETS), np.float32)
    idf = np.log((1 + total["n"][0]) / (1 + total["df"][:BUCKETS]))
    model = _Model(idf, {g[1:]: v[:-1] * idf / v[-1] for g, v in total.items() if g[:1] == "x"})
    held = store.sparkSession.sparkContext.broadcast(model)

    def seed(centres: np.ndarray | None) -> np.ndarray | None:
        def run(batches):
            best = (np.inf, 0, "", [], [])
            for ids, langs, row, bucket, weight in _stored(batches):
                if not len(ids):
                    continue
                chance = (mix64(ids.astype(np.uint64)) >> np.uint64(11)).astype(float) / 2**53 + 2**-54
                far = np.ones(len(ids))
                if centres is not None:
                    far = np.square(1 - np.minimum(held.value.similarities(centres, langs, row, bucket, weight)[0].max(axis=1), 1))
                with np.errstate(divide="ignore"):
                    at = -np.log(chance) / np.where(far > 1e-9, far, 0)  # the least is a draw by these weights
                k = np.lexsort((ids, at))[0]
                if (at[k], ids[k]) < best[:2]:
                    best = (float(at[k]), int(ids[k]), langs[k], bucket[row == k].tolist(), weight[row == k].tolist())
            yield pa.RecordBatch.from_pylist([dict(zip(("at", "id", "lang", "bucket", "weight"), best))], pa.schema([("at", pa.float64()), ("id", pa.int64()), ("lang", pa.string()), ("bucket", pa.list_(pa.int64())), ("weight", pa.list_(pa.float64()))]))

        r = store.mapInArrow(run, "at double, id long, lang string, bucket array<long>, weight array<double>").orderBy("at", "id").first()
        if r is None or r["at"] == np.inf:
            return None
        x = -model.means[r.lang]
        x[r.bucket] += np.array(r.weight) * idf[r.bucket]
        norm = np.linalg.norm(x)
        return x / norm if norm > 1e-9 else np.eye(1, BUCKETS)[0]

    centres = None
    for _ in range(TOPICS):
        new = seed(centres)
        if new is None:
            break
        centres = new[None] if centres is None else np.vstack((centres, new))
    for _ in range(ROUNDS):

        def members(ids, langs, row, bucket, weight, centres=centres):
            sims, w, norm = held.value.similarities(centres, langs, row, bucket, weight)
            best, out = sims.argmax(axis=1), {}
            w = w / norm[row]
            for k in range(len(centres)):
                own = (best == k)[row]
                out[f"s{k}"] = np.bincount(bucket[own], w[own], minlength=BUCKETS)
                for lang in set(langs[best == k]):
                    out[f"l{k} {lang}"] = np.array([(1 / norm[(best == k) & (langs == lang)]).sum()])
            return out

        new = np.zeros_like(centres)
        for r in _sums(store, members):
            if r.g[0] == "s":
                new[int(r.g[1:]), r.place] += r.n
            else:
                k, lang = r.g[1:].split(" ", 1)
                new[int(k)] -= r.n * model.means[lang]
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(norm > 1e-9, new / np.maximum(norm, 1e-9), centres)
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-6:
            break
    return idf.astype(np.float32), {k: v.astype(np.float32) for k, v in model.means.items()}, centres.astype(np.float32)


def with_topics(texts: DataFrame, *, of: DataFrame) -> DataFrame:
    """The rows (doc_id, lang, text and others) with ``topic``: the nearest centre, or null for texts without letters.
    ``of``: the unfiltered table, on all of whose texts the centres are fitted."""
    model = texts.sparkSession.sparkContext.broadcast(fit(of.where("doc_id IS NOT NULL AND text IS NOT NULL")))

    @F.arrow_udf("string")
    def topic(column: pa.Array, langs: pa.Array) -> pa.Array:
        idf, means, centres = model.value
        held, of_lang = [t or "" for t in column.to_pylist()], [x or "" for x in langs.to_pylist()]
        out: list[str | None] = []
        for lo in range(0, len(held), 500):
            x = vectors(held[lo : lo + 500]) * idf
            some = x.any(axis=1)
            for k, lang in enumerate(of_lang[lo : lo + 500]):
                if lang in means:
                    x[k] -= means[lang]
            best = (x @ centres.T).argmax(axis=1)
            out += [f"t{k}" if ok else None for k, ok in zip(best.tolist(), some.tolist())]
        return pa.array(out, pa.string())

    return texts.withColumn("topic", topic(F.col("text"), F.col("lang")))
