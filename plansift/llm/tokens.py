"""Token ids as ORC files.

One row per document in ascending order of its id: ids run-length encoded by ORC's integer codec, stripes with row indexes, and Bloom
filters on the document ids, so readers take stripes in parallel and skip those that can't hold a wanted id.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansift.llm.bpe import Words, portions
from plansift.llm.common import partitions

#: Options of the ORC writer.
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "5000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}

_open: dict = {}


#: What a tokenizer file must say for its words to be taken one by one: byte-level BPE without extras. PATTERN is that pre-tokenizer's own.
PLAIN = {"normalizer": [None], "truncation": [None], "padding": [None]}
PLAIN_CUT = {"type": ["ByteLevel"], "add_prefix_space": [False], "use_regex": [True]}
PLAIN_MODEL = {"type": ["BPE"], "dropout": [None, 0], "unk_token": [None], "continuing_subword_prefix": [None, ""], "end_of_word_suffix": [None, ""], "fuse_unk": [False], "byte_fallback": [False], "ignore_merges": [False]}


def by_words(path: str) -> bool:
    """Whether a tokenizer's file is plain byte-level BPE, whose texts may be cut into words; texts of any other go to the library whole."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    fits = lambda part, wanted: isinstance(part, dict) and all(part.get(k) in values for k, values in wanted.items())
    odd = ("single_word", "lstrip", "rstrip", "normalized")
    return fits(known, PLAIN) and fits(known.get("pre_tokenizer"), PLAIN_CUT) and fits(known.get("model"), PLAIN_MODEL) and not any(t.get(k) for t in known.get("added_tokens", []) for k in odd)


class Whole:
    """Ids of whole texts by the library, a few at a time."""

    def __init__(self, tokenizer, some: int = 64):
        self.tokenizer, self.some = tokenizer, some

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = []
        for at in range(0, len(texts), self.some):
            each += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts.slice(at, self.some).to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])


def _encoder(path: str) -> Words | Whole:
    """By words, where the file allows it: the library's BPE model per word, its whole tokenizer for words with a special token."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, cut = tokenizer.model, regex.compile(public_tokenizers.PATTERN)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # the letters by which byte-level vocabularies write bytes: printable ones themselves, the rest from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letters = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}

        def encode(strings: list[str]) -> list[bytes]:
            out = []
            for s in strings:
                if any(t in s for t in special):
                    ids = tokenizer.encode(s, add_special_tokens=False).ids
                else:
                    ids = [t.id for piece in cut.findall(s) for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))]
                out.append(array("I", ids).tobytes())
            return out

        # a special token with white space could lie across a cut
        _open[path] = Words(encode) if by_words(path) and not any(c.isspace() for t in special for c in t) else Whole(tokenizer)
    return _open[path]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every whole text, then end_id, to ORC files at out, ranges of keys in ascending order.

    Columns: doc_id, part (the file's number in the order of keys), file_start (ids of the documents before it in its file),
    n_tokens, ids. A null text counts as empty: end_id alone. Null keys come first; rows with one key are ordered by their texts,
    so a repeated run gives the same files. An empty table gives an empty folder with a schema.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = _encoder(tokenizer), 0
        for part in portions(batches):
            ids, starts = words.texts(part.column(1))
            ends = starts + np.arange(len(starts))
            whole = np.insert(ids, starts[1:], end_id).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(whole))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), lists], ["doc_id", "file_start", "n_tokens", "ids"])
            before += int(ends[-1])

    coded = rows.mapInArrow(run, f"doc_id {kind}, file_start long, n_tokens long, ids array<int>")
    coded.select("doc_id", F.spark_partition_id().alias("part"), "file_start", "n_tokens", "ids").write.options(**ORC).orc(out)


def read_tokens(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows, or those of some documents: the filter reaches the stripes' indexes and Bloom filters."""
    rows = spark.read.orc(out)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def offsets(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of files from write_tokens: start counts the ids of all documents before it.

    Sums per file (as many rows as files) are summed in order; each document adds its place in its own file.
    """
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "file_start", "n_tokens", "ids_crc32"])

    coded = rows.select("doc_id", "part", "file_start", "ids").mapInArrow(run, f"doc_id {kind}, part int, file_start long, n_tokens long, ids_crc32 long")
    return coded.join(files, "part").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
