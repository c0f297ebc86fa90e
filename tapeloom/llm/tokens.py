"""Token counts of texts under a public tokenizer's vocabulary, whose path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file lies on the driver's machine, which sends it to the tasks; never copied into the repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public pre-splitting pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoder(vocabulary: bytes):
    """The encoder of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, *keep: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, *keep, tokens`` of every document with a text; an empty text has 0 tokens, a null one no row."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in ("doc_id", *keep)) + ", tokens bigint"

    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())  # under 1 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        for df in batches:
            out = df[["doc_id", *keep]].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) for t in df.text]
            yield out

    return docs.where(F.col("text").isNotNull()).select("doc_id", *keep, "text").mapInPandas(run, schema)
