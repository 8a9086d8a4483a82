"""The cache of recognised pages: looked up by what made them and by the content's hash."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "struct<number:int,text:string,items:array<struct<text:string,x:double,y:double,w:double,h:double>>>"
DOCUMENT = f"struct<version:string,pages:array<{PAGE}>>"


def content_hash(content: Column) -> Column:
    return F.upper(F.sha2(content, 256))


def lookup(files: DataFrame, cache: DataFrame, identity: str, version: str) -> DataFrame:
    """files (doc_id, content) plus hash and document: null where the cache has none, another version, no page, or broken JSON."""
    known = cache.where(F.col("identity") == identity).select("hash", F.from_json("body", DOCUMENT).alias("document"))
    known = known.where((F.col("document.version") == version) & (F.size("document.pages") > 0)).dropDuplicates(["hash"])
    return files.withColumn("hash", content_hash(F.col("content"))).join(known, "hash", "left")


def misses(found: DataFrame) -> DataFrame:
    return found.where(F.col("document").isNull()).drop("document")


def entry(document: Column) -> Column:
    return F.to_json(document)


def recognised(files: DataFrame, known: DataFrame, identity: str, version: str, read: Callable[[bytes], dict]) -> DataFrame:
    """doc_id, hash, document and failure of files (doc_id, content): from the cache, else by `read`, which runs on the executors.

    read gives a document ({"version", "pages"}) for a file's bytes; one that raises leaves no document, and its error's kind and
    words as the failure. Each content is read once, however many files have it.
    """
    found = lookup(files, known, identity, version)
    fresh = found.where(F.col("document").isNull()).groupBy("hash").agg(F.min("content").alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                try:
                    out.append((r.hash, json.dumps(read(bytes(r.content))), None))
                except Exception as error:
                    out.append((r.hash, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["hash", "body", "failure"])

    got = fresh.mapInPandas(run, "hash string, body string, failure string").select("hash", F.from_json("body", DOCUMENT).alias("_read"), "failure")
    return found.join(got, "hash", "left").select("doc_id", "hash", F.coalesce("document", "_read").alias("document"), "failure")


def cache_rows(found: DataFrame, identity: str) -> DataFrame:
    """The rows (identity, hash, body) to append to the cache: documents with a page that holds text or words, once per content."""
    worth = F.exists("document.pages", lambda p: (F.size(p["items"]) > 0) | (F.trim(p["text"]) != ""))
    return found.where(F.col("document").isNotNull() & worth).dropDuplicates(["hash"]).select(F.lit(identity).alias("identity"), "hash", entry(F.col("document")).alias("body"))


def checked(models: DataFrame, expected: DataFrame) -> DataFrame:
    """models (name, content) whose hashes are the expected ones; the query fails where one is missing or differs."""
    rows = expected.join(models, "name", "left").withColumn("_hash", content_hash(F.col("content")))
    fine = F.coalesce(F.col("_hash") == F.upper("sha256"), F.lit(False))
    return rows.withColumn("name", F.when(fine, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("model missing or changed: "), F.col("name"))))).select("name", "content")
