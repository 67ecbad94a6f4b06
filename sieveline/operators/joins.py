"""Joins against one row per key where one key may hold a third of all rows.

The many rows are spread over salts by a hash of their other columns, the single rows are repeated as often. The merge
hint keeps Spark from broadcasting a side that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", *, spread: list[str] | None = None, salts: int = 16) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key) on equal keys; inner, left or left_semi. Null keys match nothing.

    ``spread``: the columns of rows that spread a key; all others than the keys if not given. Rows equal in those lie
    together."""
    apart = F.pmod(F.xxhash64(*(spread or [c for c in rows.columns if c not in keys])), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", apart)
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
