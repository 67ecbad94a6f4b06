"""Hashes of letter n-grams over whole Arrow batches, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batch_grams(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of q letters of every text, each hash once per row."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(q):
        h = h * _FACTOR + codes[k : k + n]
    row = np.repeat(np.arange(len(texts)), lengths)
    whole = row[:n] == row[q - 1 :]
    row, h = row[:n][whole], _mixed(h[whole])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    return row[first], h[first].view(np.int64)


def gram_rows(df: DataFrame, id_col: str, text_col: str, q: int, *, only: np.ndarray | None = None) -> DataFrame:
    """Rows (id_col, g): the distinct n-gram hashes of each text. ``only``: a filter by the highest bits of the hash (a
    boolean vector of a power of two), outside of which nothing is returned. Null and short texts have none."""
    bits = int(np.log2(len(only))) if only is not None else 0
    kind = df.schema[id_col].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches):
        for b in batches:
            row, h = batch_grams([t or "" for t in b.column(1).to_pylist()], q)
            if held is not None:
                ok = held.value[h.view(np.uint64) >> np.uint64(64 - bits)]
                row, h = row[ok], h[ok]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h)], [id_col, "g"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, g long")


def gram_filter(df: DataFrame, column: str, bits: int = 22) -> np.ndarray:
    """Which slots of the highest bits the hashes of a column take: at most 2^bits numbers reach the driver."""

    def slots(batches):
        for b in batches:
            h = np.array(b.column(0).to_numpy()).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h >> np.uint64(64 - bits)).astype(np.int64))], ["slot"])

    out = np.zeros(1 << bits, dtype=bool)
    out[df.select(column).mapInArrow(slots, "slot long").distinct().toArrow().column(0).to_numpy()] = True
    return out
