import base64
import hashlib
import json
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plansift.llm import bpe, tokens
from plansift.llm.common import shared_path

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a", "a b", "a  b", " a", "a ", "a\nb", "a\n\nb", "a \nb", "a\r\nb", "\na", "a\n", "x\tb c", "it's we'll", "12 3.4", "日本語 текст", "a\x1cb \x1f c", "a\x85b \xa0 c", "é́ \U0001f600!", "word " * 3000, "a" * 5000, "<|endoftext|> x<|endoftext|>y", "\0 \0"]


def texts():
    rng = random.Random(5)
    alphabet = "ab é\n\t'’1 .xyzß　日"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]


def test_ids_are_the_librarys():
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ids, special_tokens={})
    words, ranks = bpe._by_ranks(RANKS, P.PATTERN), bpe.ranks(RANKS, P.PATTERN)
    all_ids, at = words.texts(pa.array(texts()))
    for text, a, b in zip(texts(), at, at[1:], strict=False):
        assert all_ids[a:b].tolist() == library.encode_ordinary(text), repr(text)
        assert ranks.decode(all_ids[a:b])[0].tobytes().decode() == text


def test_pieces_of_every_size():
    rng, ranks = random.Random(1), bpe.ranks(RANKS, P.PATTERN)
    pieces = [bytes(rng.choice(b"theinrao ") for _ in range(n)) for n in [1, 2, 3, 4, 5, 8, 9, 16, 17, 31, 64, 65, 700]]

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.ids.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                return b"".join(struct.pack("<I", ranks.ids[p]) for p in parts)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    assert ranks.pieces(pieces) == [plain(p) if p not in ranks.ids else struct.pack("<I", ranks.ids[p]) for p in pieces]
    assert ranks.pieces([]) == []


def test_long_unbroken_pieces():
    rng, ranks = random.Random(3), bpe.ranks(RANKS, P.PATTERN)
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ids, special_tokens={})
    pieces = ["".join(rng.choice("etaoinshrdluйабв日") for _ in range(1_000_000)), "=" * 100_000, "ab" * 3000, "zq" + "x" * 65, "\U0001f600" * 700]
    began = time.perf_counter()
    found = ranks.pieces([p.encode() for p in pieces])
    assert time.perf_counter() - began < 60
    for piece, got in zip(pieces, found, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library._encode_single_piece(piece.encode())


def test_the_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    calls = []

    def encode(strings):
        calls.append(len(strings))
        return [len(s).to_bytes(4, "little") for s in strings]

    words = bpe.Words(encode)
    for k in range(50):
        ids, starts = words.texts(pa.array([" ".join(["x", *(f"w{k}-{j}" for j in range(40)), "long" * 1000])]))
        assert starts.tolist() == [0, 42] and ids[-1] == 4001
        assert words.size <= 20_000 + 41 * (bpe.ENTRY + 20) and max(map(len, words.known)) <= bpe.LONGEST


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    assert tokens.by_words(path) and not tokens.by_words(P.path("word_bpe_49k.json"))
    known = json.load(open(path))
    known["pre_tokenizer"]["add_prefix_space"] = True
    known["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "own.json").write_text(json.dumps(known))
    for own in (str(tmp_path / "own.json"), P.path("word_bpe_49k.json")):
        library = Tokenizer.from_file(own)
        ids, starts = tokens._encoder(own).texts(pa.array(["Ab c", "", "x Y\n z"]))
        for text, a, b in zip(["Ab c", "", "x Y\n z"], starts, starts[1:], strict=False):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_query(spark, sf_dir):
    from plansift.llm.queries import op8_token_files

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op8_token_files(spark, sf_dir).collect()}
    start = 0
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert found.pop(key) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert not found


def test_encode_decode_of_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(1, None, "y"), (None, "null key", "z"), (2, "a", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.encode_decode(docs, RANKS, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in found) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode_decode(docs.limit(0), RANKS, P.PATTERN).collect() == []


def test_token_files(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts()[:101])] + [(7, None), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    out = shared_path(spark, "test-tokens")
    tokens.write_tokens(docs.repartition(3), out, P.path("byte_bpe_50k.json"), end_id=2)
    back = tokens.read_tokens(spark, out)
    found = tokens.offsets(back).orderBy("start").collect()
    want = {}
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.setdefault(key, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    start = 0
    for row, after in zip(found, [*found[1:], None], strict=True):
        assert row["start"] == start and (after is None or row["doc_id"] <= after["doc_id"])
        want[row["doc_id"]].remove((row["n_tokens"], row["ids_crc32"]))
        start += row["n_tokens"]
    assert not any(want.values())
    some = tokens.read_tokens(spark, out, [9])
    assert [r["doc_id"] for r in some.collect()] == [9] and "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString() or some.count() == 1


def test_no_documents(spark):
    out = shared_path(spark, "test-tokens")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), out, P.path("byte_bpe_50k.json"), end_id=2)
    assert tokens.offsets(tokens.read_tokens(spark, out)).collect() == []


def test_query_round_trip(spark, sf_dir):
    from plansift.llm.queries import op6_byte_bpe

    texts_ = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op6_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts_)
    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ids, special_tokens={})
    want = {k: library.encode_ordinary(t or "") for k, t in texts_.items()}
    assert all((r["n_tokens"], r["ids_sha256"]) == (len(want[r["doc_id"]]), hashlib.sha256(struct.pack(f"<{len(want[r['doc_id']])}I", *want[r["doc_id"]])).hexdigest()) for r in found)
    assert all(r["decoded_sha256"] == hashlib.sha256((texts_[r["doc_id"]] or "").encode()).hexdigest() for r in found)
