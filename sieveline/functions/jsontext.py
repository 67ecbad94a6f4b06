"""JSON texts whose hashes must agree byte for byte with sorted-key, non-ASCII-raw encoders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """JSON string of a text (null gives null): short escapes, lower-case \\u00xx for other control characters."""
    body = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escape in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        body = F.replace(body, F.lit(raw), F.lit("\\" + escape))
    return F.concat(F.lit('"'), F.when(body.rlike(r"[\x00-\x1f]"), _control_escapes(body)).otherwise(body), F.lit('"'))


def _control_escapes(c: Column) -> Column:
    for code in (*range(0x08), 0x0B, *range(0x0E, 0x20)):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return c


def record(fields: list[tuple[str, Column]], *, spaced: bool = False) -> Column:
    """JSON object of text fields in the given order, compact or with a blank after comma and colon; null is null."""
    colon, comma = (": ", ", ") if spaced else (":", ",")
    parts = [F.concat(F.lit(f'"{name}"{colon}'), F.coalesce(quoted(c), F.lit("null"))) for name, c in fields]
    return F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))
