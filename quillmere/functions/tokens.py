"""Token counts, length tiers and routing."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Bounds of the tiers and names of the models (fixed values).
SHORT, MEDIUM, EMBEDDABLE = 3500, 15000, 8000
SHORT_MODEL, MEDIUM_MODEL = "gpt-3.5-turbo-1106", "gpt-3.5-turbo-16k"


def estimated(text: Column) -> Column:
    """A quarter of the code points, rounded up: the counter that needs no vocabulary."""
    return F.ceil(F.length(text) / 4).cast("long")


#: Place of the rank file that ``exact`` reads if none is given, and how it divides a text before merging (a fixed value of that vocabulary).
RANKS = os.environ.get("QUILLMERE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def exact(spark: SparkSession, ranks: str = RANKS, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """A counter by a public rank file, in Arrow batches; special tokens' strings are ordinary text."""
    shipped = spark.sparkContext.broadcast(open(ranks, "rb").read())
    made: dict[int, object] = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not made:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
            made[0] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return texts.map(lambda t: None if t is None else len(made[0].encode_ordinary(t)))

    return count


def tier(n: Column) -> Column:
    return F.when(n <= SHORT, "short").when(n < MEDIUM, "medium").when(n.isNotNull(), "long")


def chat_model(n: Column) -> Column:
    """The model for a text of n tokens; null where it is too long."""
    return F.when(n <= SHORT, SHORT_MODEL).when(n < MEDIUM, MEDIUM_MODEL)


def embed_action(cached: Column, n: Column) -> Column:
    return F.when(cached, "reuse").when(n <= EMBEDDABLE, "embed").otherwise("skip")
