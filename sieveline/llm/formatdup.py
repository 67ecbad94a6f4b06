"""Problem 2: records that differ only in white space, case, width, punctuation or field order.

Progressive partition refinement. Classes of equal stripped length come first, those of one member drop out; then
classes of equal letter histogram within them; only records whose class still has several members are read again and
refined by the ordered key. Length and histogram are sums over the characters, so they are counted in numpy over whole
batches, without normalising or sorting a text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import LETTERS, WEIGHT, Block, chunks
from .shared import alnum_key, batches_of, columns_of, cut, mix64, salted_join

#: Slots of the stripped lengths: longer records share slots, which only spares less work.
LENGTH_SLOTS = 1 << 16


def _json_fields(payload: str | None) -> list[tuple[str, str]] | None:
    """Fields of one complete JSON object, by name; None if it isn't one. Non-string values count by their JSON text."""
    if not payload or not payload.strip():
        return None
    try:
        record = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    return sorted((str(k), "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)) for k, v in record.items())


def _records(batch: pa.RecordBatch, fields: list[str], payload: bool):
    """(id, [(name, text)]) of each record that counts."""
    if payload:
        ids, texts = batches_of(batch, ["id", fields[0]])
        for i, t in zip(ids, texts):
            if i is not None and (f := _json_fields(t)) is not None:
                yield i, f
    else:
        ids, *columns = batches_of(batch, ["id", *fields])
        for i, *values in zip(ids, *columns):
            if i is not None:
                yield i, list(zip(fields, values))


def invariants(records: list[list[tuple[str, str | None]]]) -> tuple[np.ndarray, np.ndarray]:
    """(stripped length, hash of the letter histograms of the fields) of each record. Both are sums over the letters of
    the fully decomposed text, so records that are equal up to formatting have equal ones. Empty fields add nothing."""
    owner, names, texts = [], [], []
    for k, fields in enumerate(records):
        for name, text in fields:
            if text:
                owner.append(k)
                names.append(name)
                texts.append(text)
    total, hist = np.zeros(len(records), dtype=np.int64), np.zeros(len(records), dtype=np.uint64)
    salt = {n: np.uint64(xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass"))) for n in set(names)}
    owner = np.array(owner, dtype=np.int64)
    for lo, hi in chunks(list(map(len, texts))):
        block = Block(texts[lo:hi])
        n = np.add.reduceat(LETTERS(block.codes).astype(np.int64), block.starts)
        h = np.add.reduceat(WEIGHT(block.codes), block.starts)
        of_name = np.array([salt[x] for x in names[lo:hi]], dtype=np.uint64)
        np.add.at(total, owner[lo:hi], n)
        np.add.at(hist, owner[lo:hi], np.where(n > 0, mix64(mix64(h ^ of_name) + n.astype(np.uint64)), np.uint64(0)))
    return total, hist


def _ordered_key(fields: list[tuple[str, str | None]]) -> bytes:
    return xxhash.xxh3_128_digest("\x01".join(f"{n}\x00{k}" for n, t in fields if (k := alnum_key(t))).encode("utf-8", "surrogatepass"))


def format_duplicates(df: DataFrame, id_col: str, fields: list[str], *, payload: bool = False) -> DataFrame:
    """Rows (id, keep_id, copies): every record of a class of at least two, its class's smallest id and size.

    ``payload``: ``fields`` names one column of JSON text whose objects are the records. A record delivered several
    times under one id counts once. Null and empty fields are equal; a null id and text that is no complete JSON
    object are no records; an empty table gives no rows. Columns besides the named ones are never read."""
    spare = sorted(fields)
    rows = df.select(F.col(id_col).alias("id"), *spare)

    def cheap(batches):
        for b in batches:
            found = list(_records(b, spare, payload))
            n, h = invariants([f for _, f in found])
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array(n), pa.array(h.view(np.int64))], ["id", "n", "hist"])

    def exact(batches):
        for b in batches:
            out = [(i, _ordered_key(f)) for i, f in _records(b, spare, payload)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["id", "key"])

    # 24 bytes a record; the texts aren't read again for the next two steps.
    first = cut(rows.mapInArrow(cheap, "id long, n long, hist long"))
    slot = F.pmod("n", F.lit(LENGTH_SLOTS))
    # 1. Lengths: at most LENGTH_SLOTS counters reach the driver.
    several = np.zeros(LENGTH_SLOTS, dtype=bool)
    several[columns_of(first.groupBy(slot.alias("slot")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("slot"))["slot"]] = True
    several = df.sparkSession.sparkContext.broadcast(several)

    def refined(batches):
        for b in batches:
            yield b.filter(pa.array(several.value[b.column(1).to_numpy() % LENGTH_SLOTS]))

    first = first.mapInArrow(refined, "id long, n long, hist long")
    # 2. Histograms. A class may be one third of all rows: min and max combine before the shuffle, no class is gathered.
    classes = first.groupBy("n", "hist").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("n", "hist")
    members = salted_join(first, classes, ["n", "hist"], "left_semi").select("id").distinct()
    # 3. The ordered key, of members only.
    second = rows.join(members.hint("merge"), "id", "left_semi").mapInArrow(exact, "id long, key binary").distinct()
    groups = second.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
    return salted_join(second, groups, ["key"]).select("id", "keep_id", "copies")
