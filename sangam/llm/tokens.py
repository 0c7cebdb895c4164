"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this family cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str):
    """The tokenizer of a ranks file (base64 token and rank a line); one per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, id_col: str, text: str, extra: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n, *extra): tokens of each text; null and empty texts have none."""
    extra = extra or []
    cols = [F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *extra]
    schema = "id long, n long" + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = np.fromiter((len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *b.columns[2:]], names=["id", "n", *extra])

    return df.select(*cols).mapInArrow(run, schema)
