"""Helpers shared by the training-data operators: tables, lineage cuts, text keys, n-gram hashes."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import salted_join  # noqa: F401  (used by the operators)
from ..session import cut_lineage as cut  # noqa: F401

NOT_ALNUM = re.compile(r"[\W_]+")
NOT_ALNUM_ASCII = re.compile(r"[^a-z0-9]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_key(text: str | None) -> str:
    """Letters and digits only, with width, case, white space and punctuation taken away; null gives ''."""
    if not text:
        return ""
    if text.isascii():
        return NOT_ALNUM_ASCII.sub("", text.lower())
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return NOT_ALNUM.sub("", text.casefold())


# 64-bit odd multiplier of the rolling hash and the finaliser of the splitmix64 generator.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of every window of q code points; empty if the text is shorter."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    c = codes.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(q):
        h *= _BASE
        h += c[i : i + n]
    return mix64(h)


def gram_hashes_many(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of every q-gram of every text, computed over all texts at once."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    h = gram_hashes(code_points("".join(texts)), q)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(texts)), lengths)[: len(h)]
    pos = np.arange(len(h)) - starts[row]
    ok = pos <= lengths[row] - q
    return row[ok], pos[ok], h[ok]


def batches_of(batch: pa.RecordBatch, columns: list[str]) -> list[list]:
    return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]


def columns_of(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a result whose size is bounded, fetched as Arrow: rows never become objects on the driver."""
    fetched = df.toArrow()
    return {c: fetched.column(c).to_numpy() for c in df.columns}


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def bounded_sample(df: DataFrame, keys: list[str], n: int, *, of: DataFrame) -> DataFrame:
    """At most n rows, of lowest hash of the keys; the same rows however the table is partitioned.

    Rows above a hash bound that leaves about twice the wanted number are dropped in their tasks, so partitions don't
    send n rows each to the driver. ``of``: the unfiltered table, whose rows are counted without reading a column."""
    bound = min(1.0, 2.0 * n / max(1, of.count()))
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    return df.withColumn("_h", h).where(F.col("_h") <= F.lit(int(bound * (1 << 40)))).orderBy("_h", *keys).limit(n).drop("_h")
