"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackframe.storage import fresh_path, give_back, local_path, map_arrow, ship, written

__all__ = ["alone", "binary_values", "blocks_for", "crc_mod", "fresh_path", "local_path", "map_arrow", "n_words", "read_table", "ship", "tokenizer_file", "written"]

#: A word is a run of bytes other than ASCII white space. bytes.split() splits in the same places.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def crc_mod(col, m: int):
    """crc32 of a value as text, modulo m; null stays null."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(m))


def n_words(text):
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_values(array) -> list[bytes]:
    """A pyarrow string column as bytes, null as empty, without decoding."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


_remembered: list = []


def alone(*caches) -> None:
    """Say at a task's start which caches it uses; those of other operators in this Python worker are emptied, and their memory returned."""
    others = [cache for cache in _remembered if cache and not any(cache is x for x in caches)]
    for cache in others:
        cache.clear()
    _remembered[:] = caches
    if others:
        give_back()
