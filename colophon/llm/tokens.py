"""Token counts of texts with a public tokenizer, as a narrow Arrow pass."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        _LOADED[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(df: DataFrame, key: str, text: str, extra: list[str], path: str = TOKENIZER, terms: bool = False) -> DataFrame:
    """(key, *extra, n_tokens[, terms, freqs]) of rows with text; NULL and empty texts have no tokens and are left out.

    ``terms`` adds the distinct token ids and how often each occurs.
    """
    source = df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *extra
    )
    kept = [f for f in source.schema.fields if f.name != "text"]
    target = source.select(*[f.name for f in kept]).withColumn("n_tokens", F.lit(0).cast("int"))
    if terms:
        target = target.withColumn("terms", F.array().cast("array<int>")).withColumn("freqs", F.array().cast("array<int>"))
    at = source.columns.index("text")

    def run(batches):
        import numpy as np

        encode = encoder(path)
        for batch in batches:
            ids = [encode.encode_ordinary(t) for t in batch.column(at).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns.append(pa.array([len(x) for x in ids], pa.int32()))
            names = [f.name for f in kept] + ["n_tokens"]
            if terms:
                pairs = [np.unique(np.array(x, np.int32), return_counts=True) for x in ids]
                columns.append(pa.array([a for a, _ in pairs], pa.list_(pa.int32())))
                columns.append(pa.array([b.astype(np.int32) for _, b in pairs], pa.list_(pa.int32())))
                names += ["terms", "freqs"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, target.schema)
