"""Token counts of texts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import batches_of

#: Vocabulary of the token counts and the pattern that cuts texts before byte pairs are merged.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_LOADED: dict = {}


def encoder(path: str):
    """The byte-pair encoder of a rank file; loaded once in each worker."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(texts: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The rows with column ``text`` replaced by ``tokens`` (bigint). Null and empty texts have 0 tokens; a string of a
    special token counts as ordinary text; texts are encoded whole."""
    keep = [c for c in texts.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")

    def count(batches):
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t.encode("utf-8", "replace").decode("utf-8"))) if t else 0 for t in batches_of(b, ["text"])[0]]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(n, pa.int64())], [*keep, "tokens"])

    return texts.mapInArrow(count, f"{schema}, tokens bigint")
