"""What several operators of this subpackage share."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Folder with the vocabularies of public tokenizers; every operator that needs one takes it as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"
#: The public split pattern that belongs to the rank files (fixed value).
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def label_key(label: Column) -> Column:
    """The letters a-z of a label in lower case; labels with the same key name the same thing. Null if no letter is left."""
    key = F.regexp_replace(F.lower(label), "[^a-z]", "")
    return F.when(key != "", key)


@lru_cache(maxsize=4)
def encoder(tokenizer_dir: str, name: str = "byte_bpe_50k.tiktoken"):
    """The tokenizer of a rank file, loaded once per Python process."""
    import tiktoken

    with open(os.path.join(tokenizer_dir, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], tokenizer_dir: str) -> list[int]:
    """Tokens of each text; 0 for null."""
    enc = encoder(tokenizer_dir)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def with_token_counts(df: DataFrame, texts: dict[str, str], keep: list[str], tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """The columns `keep` of df and, for each name of `texts`, the length of that column in tokens; whole texts, one Arrow pass."""
    import pyarrow as pa
    from pyspark.sql import types as T

    kept, read = [f"k{i}" for i in range(len(keep))], [f"t{i}" for i in range(len(texts))]
    columns = [F.col(c).alias(k) for c, k in zip(keep, kept)] + [F.col(c).cast("string").alias(t) for c, t in zip(texts.values(), read)]
    picked = spread(df.select(*columns))
    counts = [f"n{i}" for i in range(len(texts))]
    schema = T.StructType([*(T.StructField(k, picked.schema[k].dataType) for k in kept), *(T.StructField(n, T.LongType()) for n in counts)])

    def count(batches):
        for b in batches:
            sizes = [pa.array(count_tokens(b.column(t).to_pylist(), tokenizer_dir), pa.int64()) for t in read]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *sizes], names=[*kept, *counts])

    counted = picked.mapInArrow(count, schema)
    return counted.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *[F.col(n).alias(c) for n, c in zip(counts, texts)])
