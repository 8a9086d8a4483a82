"""SimHash near-duplicates: fingerprints, links at a small Hamming distance by pivot tables, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import labelled, partitions, stored

#: Reference fingerprints of the pivot table.
PIVOTS = 16
#: A bucket with more fingerprints is dealt out again by blocks of its other bits.
CROWDED = 2048


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit SimHash of a text's shingles, repeats included.

    A-Z lower-cased, words cut at space and \\x09-\\x0D; fewer words than a shingle: the whole sequence; none: zero. A bit is 1 if it
    is set in over half the shingles' XXH64 (UTF-8, seed 42).
    """
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    firsts = [0, *ends[: len(parts) - words].tolist()]
    lasts = (ends[words - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    shingles = np.array([hashed(joined[a:b], 42) for a, b in zip(firsts, lasts, strict=True)], dtype=">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 8192):
        total += np.unpackbits(shingles[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, and fp (long, the fingerprint's bits) of every row; a null text counts as empty."""
    rows = docs.select(key, *keep, F.col(text).alias("_text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", words) for t in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))], [key, *keep, "fp"])

    return rows.mapInArrow(run, f"{shape}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: any fixed set does; these are hashes of 0, 1, ..."""
    return np.array([xxhash.xxh64_intdigest(str(k), 7) for k in range(n)], np.uint64)


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def linked(bucket: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs in the same bucket (sorted) at most radius apart, reduced to links that keep each bucket's components.

    A pair is dropped if any pivot's two distances differ by more than radius (the triangle inequality), and what is left is
    measured. Pairs are taken at offset 1, 2, ...; a row's links go to the least root so far, so a bucket leaves one link per
    row that isn't a root.
    """
    n = len(fp)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows = np.arange(n - 1)
    offset = 1
    while len(rows):
        rows = rows[rows + offset < n]
        rows = rows[bucket[rows] == bucket[rows + offset]]
        near = rows[(np.abs(table[rows] - table[rows + offset]) <= radius).all(axis=1)]
        near = near[np.bitwise_count(fp[near] ^ fp[near + offset]) <= radius]
        for a in near.tolist():
            x, y = find(a), find(a + offset)
            if x != y:
                root[max(x, y)] = min(x, y)
        offset += 1
    a = np.flatnonzero(root != np.arange(n))
    return a, np.array([find(x) for x in a.tolist()], dtype=np.int64)


def _blocks(bits: list[int], radius: int) -> list[list[int]]:
    """bits cut into radius + 2 blocks: two of them are equal in any pair at most radius apart."""
    return [list(x) for x in np.array_split(np.array(bits), radius + 2)]


def _bits(path: int, radius: int) -> tuple[list[int], list[int]]:
    """The bits by which the buckets of a path are dealt, and those left. A path has two decimal digits for each pair of blocks, from 1."""
    used, rest = [], list(range(64))
    for x in [path // 100**k % 100 for k in range(10) if path >= 100**k][::-1]:
        a, b = list(combinations(_blocks(rest, radius), 2))[x - 1]
        used += a + b
        rest = [bit for bit in rest if bit not in a + b]
    return used, rest


def _levels(radius: int) -> int:
    """How often fingerprints can be dealt out with a bit at least in each block."""
    n, rest = 0, 64
    while rest >= radius + 2:
        n, rest = n + 1, rest - 2 * -(-rest // (radius + 2))
    return n


def _dealt(radius: int, again: bool):
    """Rows (pair, bucket, fp, near): the fingerprint once for each pair of blocks; again: by two blocks of the bits its path has left."""
    refs = pivots()

    def value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
        out = np.zeros(len(fp), np.uint64)
        for k, bit in enumerate(bits):
            out |= (fp >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy().view(np.uint64)
            near = np.empty(len(fp), object)
            near[:] = frame["near"].tolist() if again else list(map(bytes, pivot_table(fp, refs)))
            paths = frame["pair"].to_numpy() if again else np.zeros(len(fp), np.int64)
            for path in np.unique(paths).tolist():
                some, kept = fp[paths == path], near[paths == path]
                used, rest = _bits(path, radius)
                for y, (a, b) in enumerate(combinations(_blocks(rest, radius), 2)):
                    yield pd.DataFrame({"pair": np.int64(100 * path + y + 1), "bucket": value(some, used + a + b).view(np.int64), "fp": some.view(np.int64), "near": kept})

    return run


def _verified(radius: int, most: int = 1 << 16):
    """Of rows sorted by pair and bucket: links (a, b) between their fingerprints. Holds whole buckets of at least `most` rows at a time."""

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        group = frame.groupby(["pair", "bucket"], sort=False).ngroup().to_numpy()
        fp = frame["fp"].to_numpy().view(np.uint64)
        table = np.frombuffer(b"".join(frame["near"]), np.int8).reshape(len(fp), -1)
        a, b = linked(group, fp, table, radius)
        return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows >= most:
                whole = pd.concat(held, ignore_index=True)
                last = whole.iloc[-1]
                open_ = ((whole["pair"] == last["pair"]) & (whole["bucket"] == last["bucket"])).to_numpy()
                if not open_.all():
                    yield part(whole[~open_])
                held, rows = [whole[open_]], int(open_.sum())
        if rows:
            yield part(pd.concat(held, ignore_index=True))

    return run


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at most radius bits apart, directly or by way of others.

    fps: column fp. Every such pair shares two of radius + 2 blocks of bits, which deals the fingerprints into buckets; in a bucket,
    distances to the references discard pairs, and the rest are measured. A bucket of more than CROWDED fingerprints is dealt out
    again by the same rule over its other bits, until none is crowded or too few bits are left; so no pair is lost.
    """
    spark = fps.sparkSession
    n = partitions(spark)
    shape = "pair long, bucket long, fp long, near binary"
    dealt = stored(fps.select("fp").distinct().mapInPandas(_dealt(radius, False), shape), "buckets")
    done = []
    for level in range(1, _levels(radius)):
        crowds = stored(dealt.groupBy("pair", "bucket").count().where(F.col("count") > CROWDED).select("pair", "bucket"), "crowds")
        if crowds.isEmpty():
            break
        done.append(dealt.join(crowds, ["pair", "bucket"], "left_anti"))
        dealt = stored(dealt.join(crowds, ["pair", "bucket"], "left_semi").mapInPandas(_dealt(radius, True), shape), f"buckets{level}")
    dealt = reduce(DataFrame.unionByName, done, dealt)
    sorted_ = dealt.repartition(n, "pair", "bucket").sortWithinPartitions("pair", "bucket")
    return sorted_.mapInPandas(_verified(radius), "a long, b long")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, fp, label (alike in a component, never null) and component_id (its smallest key) of every row."""
    found = stored(fingerprints(docs, key, text, words, keep), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min(key).alias("least"))
    nodes = stored(labelled(nodes, "fp", links(nodes, radius)), "nodes")
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    names = nodes.join(least, "label").select("fp", "label", "component_id")
    return found.join(names, "fp").select(key, *keep, "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """key, fp and component_id of every row: the smallest key reachable by links between fingerprints at most radius bits apart.

    Exact copies share a fingerprint and are one node, whatever their number. Rows without words have fingerprint zero and link like
    any other; a null text counts as empty. Null keys are kept but never name a component unless all keys of it are null. Repeated
    rows each come back. An empty table gives no rows.
    """
    return grouped(docs, key, text, words, radius).select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, all its columns: that of the smallest key; among rows with that key, the least by a hash of the text."""
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # two halves, so that a null key is told apart from every other
    keys = docs.select(key, text, F.col(key).isNull().alias("_no_key"), own.alias("_hash"))
    found = stored(grouped(keys, key, text, words, radius, ("_no_key", "_hash")), "groups")
    kept = found.groupBy("label").agg(F.min(F.struct("_no_key", key, "_hash")).alias("k")).select(F.coalesce(f"k.{key}", F.lit(0)).alias("_kept"), "k._no_key", "k._hash").distinct()
    rows = docs.withColumns({"_kept": F.coalesce(key, F.lit(0)), "_no_key": F.col(key).isNull(), "_hash": own})
    rows = rows.join(kept, ["_kept", "_no_key", "_hash"], "left_semi")
    if not found.groupBy(key, "_hash").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["_kept", "_no_key", "_hash"])
    return rows.select(docs.columns)
