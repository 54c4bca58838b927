"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder and file of the vocabulary; both are parameters of every function here.
FOLDER = os.environ.get("LITLAKE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ship(spark: SparkSession, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> None:
    """Sends the vocabulary's file with the job, so that only the driver's machine needs ``folder``."""
    path = os.path.join(folder, vocabulary)
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


def _file(folder: str, vocabulary: str) -> str:
    sent = SparkFiles.get(vocabulary) if SparkFiles._root_directory else ""
    return sent if sent and os.path.exists(sent) else os.path.join(folder, vocabulary)


@lru_cache(maxsize=2)
def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per Python worker."""
    import tiktoken

    with open(_file(folder, vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens; null for null.  Equal texts of an Arrow batch are counted once."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        coder = encoding(folder, vocabulary)
        known = {t: len(coder.encode_ordinary(t)) for t in set(texts.dropna())}
        return texts.map(known.get, na_action="ignore").astype("Int64")

    return count(text)
