"""Sinks and integrity: ordered JSONL, JSON documents, hashes, fingerprints, manifests and deterministic archives."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import tarfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[str], line: Column, *, single: bool = False) -> None:
    """One JSON text per row, in order, UTF-8, \\n; an existing output is an error. Files are sorted ranges whose names
    follow the order; ``single`` makes one file of them, which one task writes."""
    rows = df.select(*order, line.alias("value")).where(F.col("value").isNotNull())
    rows = (rows.coalesce(1) if single else rows).sortWithinPartitions(*order) if single else rows.orderBy(*order)
    rows.select("value").write.mode("errorifexists").text(path, lineSep="\n")


def write_json(value: object, path: str) -> None:
    """A JSON document, indented by 2; it is written beside its place and renamed, so readers see all of it or none."""
    part = f"{path}.tmp"
    with open(part, "w", encoding="utf-8", newline="\n") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(part, path)


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, sha256) of whole files, each hashed by the task that reads it (up to 2 GB a file)."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def hash_gate(hashes: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``expected`` (key, sha256) whose file is missing or has another hash; empty if all agree."""
    e = expected.select(key, F.col("sha256").alias("expected"))
    return e.join(hashes.select(key, "sha256"), key, "left").where(~F.col("sha256").eqNullSafe(F.col("expected")))


def require_empty(df: DataFrame, message: str) -> None:
    """Raises with a few of the rows unless the frame is empty."""
    if rows := df.take(5):
        raise ValueError(f"{message}: {rows}")


def ordered_fingerprint(df: DataFrame, order: list[str], row: Column, *, end: str = "\n") -> str:
    """SHA-256 over the rows' texts in order. Serial by nature: rows stream through the driver, one at a time."""
    digest = hashlib.sha256()
    for r in df.select(*order, row.alias("_t")).orderBy(*order).select("_t").toLocalIterator(prefetchPartitions=True):
        digest.update(((r["_t"] or "") + end).encode("utf-8"))
    return digest.hexdigest()


def set_fingerprint(df: DataFrame, row: Column) -> DataFrame:
    """One row (records, digest): an order-free digest of the rows' texts, which partitions compute on their own.
    It is another value than the ordered fingerprint; null texts count as ''."""
    h = F.sha2(F.coalesce(row, F.lit("")), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("records"), *[part(k).alias(f"s{k}") for k in range(4)]).select("records", F.sha2(F.concat_ws(":", *[F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("string") for k in range(4)]), 256).alias("digest"))


def copy_bytes(source: str, target: str) -> str:
    """Copies a file byte for byte, through a neighbour that is renamed; returns its SHA-256. An existing target is an
    error."""
    if os.path.exists(target):
        raise FileExistsError(target)
    digest = hashlib.sha256()
    with open(source, "rb") as src, open(f"{target}.tmp", "wb") as out:
        while chunk := src.read(1 << 20):
            digest.update(chunk)
            out.write(chunk)
    os.replace(f"{target}.tmp", target)
    return digest.hexdigest()


def gated(df: DataFrame, hashes: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """The frame, if every expected file is there with its hash; else an error with the first files that aren't."""
    require_empty(hash_gate(hashes, expected, key), "files differ from what is expected")
    return df


def block_hashes(blocks: DataFrame, ids: str, keys: list[str]) -> DataFrame:
    """Rows (keys, sha256): the hash of each block of ids as a buffer of little-endian 64-bit integers."""

    @F.arrow_udf("string")
    def hashed(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.sha256(np.asarray(x, dtype="<i8").tobytes()).hexdigest() for x in column.to_pylist()], pa.string())

    return blocks.select(*keys, hashed(F.col(ids).cast("array<bigint>")).alias("sha256"))


def identity_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (key, left, right, problem) of two one-row identities: every key whose values differ (nulls are equal), as
    texts; a side of no or several rows gives one row with key null and says so in ``problem``. No rows: they agree."""
    one = lambda d: d.agg(F.count("*").alias("n"), *[F.min(F.struct(F.col(k).cast("string").alias("v"))).alias(k) for k in keys])
    both = one(left).select(*[F.col(c).alias(f"l_{c}") for c in ("n", *keys)]).crossJoin(one(right).select(*[F.col(c).alias(f"r_{c}") for c in ("n", *keys)]))  # one row each
    side = lambda s, n: F.when(F.col(n) == 0, f"the {s} side is empty").when(F.col(n) > 1, f"the {s} side has several rows")
    faulty = F.struct(F.lit(None).cast("string").alias("key"), F.col("l_n").cast("string").alias("left"), F.col("r_n").cast("string").alias("right"), F.coalesce(side("left", "l_n"), side("right", "r_n")).alias("problem"))
    per = [F.struct(F.lit(k).alias("key"), F.col(f"l_{k}.v").alias("left"), F.col(f"r_{k}.v").alias("right"), F.lit("values differ").alias("problem")) for k in keys]
    rows = F.when(faulty["problem"].isNotNull(), F.array(faulty)).otherwise(F.filter(F.array(*per), lambda x: ~x["left"].eqNullSafe(x["right"])))
    return both.select(F.inline(rows))


def same_identity(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    """Whether two one-row identities agree on the keys, nulls included."""
    return not identity_differences(left, right, keys).take(1)


def _digest_of(stream) -> str:
    digest = hashlib.sha256()
    while chunk := stream.read(1 << 20):
        digest.update(chunk)
    return digest.hexdigest()


def package(root: str, members: list[str], path: str) -> list[dict]:
    """A tar.gz of the members, byte for byte the same for the same input: sorted names, no times or owners. The
    archive is read again and checked; returns the manifest (name, bytes, sha256)."""
    if os.path.exists(path):
        raise FileExistsError(path)
    manifest = []
    with open(path, "wb") as f, gzip.GzipFile(filename="", mode="wb", fileobj=f, mtime=0) as z, tarfile.open(fileobj=z, mode="w|", format=tarfile.PAX_FORMAT) as tar:
        for name in sorted(members):
            info = tarfile.TarInfo(name)
            info.size, info.mode = os.path.getsize(os.path.join(root, name)), 0o644
            with open(os.path.join(root, name), "rb") as member:
                tar.addfile(info, member)
            with open(os.path.join(root, name), "rb") as member:
                manifest.append({"name": name, "bytes": info.size, "sha256": hashlib.file_digest(member, "sha256").hexdigest()})
    with tarfile.open(path, "r|gz") as tar:
        again = [{"name": m.name, "bytes": m.size, "sha256": _digest_of(tar.extractfile(m))} for m in tar]
    if again != manifest:
        raise ValueError(f"{path} doesn't hold what was put in")
    return manifest
