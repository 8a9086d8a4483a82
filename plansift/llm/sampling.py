"""Bounded samples for fitting, and folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer texts (in code points) aren't used for fitting; all are scored.
FIT_CHARS = 10_000


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % n


def texts_of(docs: DataFrame, keys: DataFrame, key: str = "doc_id", text: str = "text", at_most: int = FIT_CHARS) -> list[tuple]:
    """The rows of keys with their texts: (..., text). keys must be a bounded sample; it is broadcast."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).where(F.length("_text") <= at_most)
    return sorted((tuple(r) for r in rows.join(F.broadcast(keys), key).select(*keys.columns, "_text").collect()), key=lambda r: (str(r[:-1]), r[-1]))


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows, those least by a hash of the key."""
    return rows.where(F.col(key).isNotNull()).orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def portions(batches: Iterator[pa.RecordBatch], text: int, rows: int = 512, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that a portion has few rows and, unless it is one long text, few characters; with the texts, nulls as empty."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, size = [], 0
            for value in batch.column(text).slice(at, rows):
                value = value.as_py() or ""
                if texts and size + len(value) > chars:
                    break
                texts.append(value)
                size += len(value)
            yield batch.slice(at, len(texts)), texts
            at += len(texts)
