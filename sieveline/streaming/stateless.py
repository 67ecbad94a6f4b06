"""The stateless operators over streams: validation and flags. Ordered deduplication needs a total order and is for
batches; a stream deduplicates by key within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import is_blank
from ..operators.flags import Rules, flags
from ..sources.jsonl import validate_lines


def validated(lines: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """Streamed lines (value) with fields and ``error``; blank lines are dropped."""
    return validate_lines(lines.where(~is_blank(F.col("value"))), required, optional, text="value")


def flagged(rows: DataFrame, text: str, rules: Rules = Rules()) -> DataFrame:
    named = flags(F.col(text), rules)
    excluded = F.lit(False)
    for n in rules.excluding:
        excluded = excluded | named[n]
    return rows.withColumns(named | {"excluded": excluded})


def deduplicated(rows: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """First arrivals of a key within the watermark; state is dropped behind it."""
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
