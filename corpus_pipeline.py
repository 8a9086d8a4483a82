"""A corpus pipeline of five stages; each takes the documents that the one before kept, whole.

Toxic documents go, one document of each group of near-duplicates stays, documents that hold benchmark items go, secrets are
replaced by a mark, and what is left is encoded. A clean document passes every stage as it was.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from plansift.llm.common import discard, last_stored, scratch, stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.3, as they were; the model is fitted to confirmed and unlabelled texts among docs.

    A null text counts as empty and scores by the bias alone; a very long one is scored whole. Repeated rows score alike and all
    stay or all go; null ids are scored, never fitted on. Without labels nothing is toxic. An empty table stays one. Columns may be
    missing or more, whatever their names.
    """
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, name="_score").where(F.col("_score") < 0.3).select(docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, as it was.

    Null and empty texts are alike, one of them stays. Rows that repeat wholly are one; rows with one id and texts of their own are
    told apart by a hash. A null id is kept where its group has no other. Very long texts count whole. An empty table stays one;
    other columns pass through, whatever their names.
    """
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of an item's size is similar to it, as they were.

    Null and empty texts hold nothing; items without words match nothing. A very long text is looked at in chunks with margins, so
    whole. Rows that share id and text go together; a null id is like any other. With an empty benchmark all stay.
    """
    return decontaminate.clean(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark, n_chars counted anew.

    A null text becomes an empty one; texts without secrets are as they were. Each row is looked at for itself, so null ids and
    repeated rows don't matter. Very long texts are scanned whole. Other columns pass through.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = secret_scan.scan(docs, keep=others).withColumn("_secrets", secret_scan.secrets())
    return found.withColumn("text", secret_scan.redacted("text", F.col("_secrets"))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every row: byte-level BPE and back.

    A null or empty text has no ids. Each row is encoded for itself, so null ids and repeated rows don't matter; very long texts are
    encoded whole. Other columns are left behind. An empty table gives no rows.
    """
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("byte_level_bpe", encoded),
]

#: The stages learn models and hash with XXH64, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """All stages over documents; between two of them the documents are written to the shared folder and read again.

    When a stage's documents are written, what the stages before left in that folder is deleted, unless keep is set.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark, keep) as wanted:
            docs = stored(stage(spark, docs, sf_dir), name)
            wanted.append(last_stored())
        if not keep:
            discard(spark, before)
        before = wanted
    return STAGES[-1][1](spark, docs, sf_dir)
