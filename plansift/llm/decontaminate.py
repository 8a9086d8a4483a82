"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Built-in functions only. What is broadcast comes from the benchmark alone, after its size has been counted.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import stored

#: Words of a shingle, the least similarity of a leak, and the fingerprint distance within which candidates are verified.
WORDS, SIMILARITY, RADIUS = 5, 0.8, 23
BLOCKS, BLOCK_BITS = 8, 8
#: Bytes that a broadcast may take, by the rows counted beforehand and what a row of each kind takes there. A larger benchmark goes in portions.
BROADCAST_BYTES, ANCHOR_BYTES, BLOCK_BYTES, HASH_BYTES = 48 << 20, 72, 96, 16
#: Shingles of a document that are looked at together, besides the margins that windows need.
CHUNK = 1024


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(words_: str, k: int) -> Column:
    """The hash of each k neighbouring words, in order; none if there are fewer."""
    hashed = F.transform(F.col(words_), lambda w, i: F.xxhash64(w, *[F.get(F.col(words_), i + j) for j in range(1, k)]))
    return F.slice(hashed, 1, F.greatest(F.size(words_) - (k - 1), F.lit(0)))


def counted(hashes: Column) -> Column:
    """A bag of hashes as a set: each with the number of its like before it."""
    ordered = F.array_sort(hashes)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i - F.array_position(ordered, h).cast("int")))


def items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, n (words), k (words of its shingles: WORDS, or n if fewer), hashes; items without words are left out."""
    rows = benchmark.select(F.col(key).alias("item"), words(F.coalesce(F.col(text), F.lit(""))).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("n", F.size("w")).withColumn("k", F.least(F.col("n"), F.lit(WORDS)))
    hashes = reduce(lambda rest, k: F.when(F.col("k") == k, shingles("w", k)).otherwise(rest), range(2, WORDS + 1), shingles("w", 1))
    return rows.select("item", "n", "k", hashes.alias("hashes"))


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """key, _text_hash, item, start, hamming, similarity: the documents that hold benchmark items, each with its best window.

    A window has as many words as the item (or the whole document, if shorter). The similarity of windows rises and falls only where
    a shingle of the item enters or leaves, so the best starts where a shared shingle is the window's first or last or lies as it
    does in the item. Windows whose SimHash is at most RADIUS bits from an item of that size meet it in one of BLOCKS blocks (a block
    at most RADIUS // BLOCKS bits off), and those are verified: shared over all shingles, each counted as often as it occurs, at
    least SIMILARITY. Nulls count as empty and never leak; items without words match nothing; shorter items than a shingle are one.
    A very long document is looked at in chunks with margins, so no window is missed and none carries the whole. Rows with the same
    key and text give their leaks once; rows that share a key alone are told apart by _text_hash.

    What is broadcast comes from the benchmark alone and is counted first: items that would take more than BROADCAST_BYTES are dealt
    into portions, one pass over the documents each.
    """
    known = stored(items(benchmark, item), "items")
    size = known.agg(F.sum(F.size("hashes")).alias("shingles"), F.count("*").alias("items"), F.max(F.size("hashes")).alias("longest"), F.collect_set("k").alias("ks")).first()
    shingles_n, items_n = size["shingles"] or 0, size["items"]
    bytes_ = 3 * shingles_n * ANCHOR_BYTES + items_n * len(_neighbours()) * BLOCK_BYTES + shingles_n * HASH_BYTES
    portions = -(-bytes_ // BROADCAST_BYTES)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("_key", F.xxhash64("_text").alias("_text_hash"), words(F.col("_text")).alias("w"))
    ks = sorted(size["ks"]) or [WORDS]
    rows = rows.select("_key", "_text_hash", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), shingles("w", k).alias("all")) for k in ks])).alias("s"))
    rows = rows.select("_key", "_text_hash", "s.k", F.size("s.all").alias("total"), F.col("s.all").alias("all"))
    if portions <= 1:
        found = _best(rows, known, ks, size["longest"] or 1, shingles_n)
    else:
        dealt = known.withColumn("portion", F.pmod(F.xxhash64("item", "hashes"), F.lit(portions)))
        found = reduce(DataFrame.unionByName, [stored(_best(rows, dealt.where(F.col("portion") == p).drop("portion"), ks, size["longest"], shingles_n // portions), "leaks") for p in range(portions)])
    best = found.groupBy("_key", "_text_hash", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("hamming")).alias("hamming"))).alias("best"))
    return best.select(F.col("_key").alias(key), "_text_hash", F.col("item").alias(item), (-F.col("best.start")).alias("start"), (-F.col("best.hamming")).cast("int").alias("hamming"), F.col("best.similarity").alias("similarity"))


def _bitmap(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test that all of these hashes pass and few others: a bit for each, by its lowest bits. It spares most rows of the join."""
    mask = 1 << max(12, min(22, (64 * n).bit_length()))
    cells = hashes.select((F.col("h").bitwiseAND(F.lit(mask - 1))).alias("b")).distinct().select(F.shiftright("b", 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    cells = {r["cell"]: r["bits"] for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()}
    bitmap = F.from_json(F.lit(json.dumps([cells.get(c, 0) for c in range(mask >> 6)])), "array<bigint>")
    return lambda h: F.getbit(F.get(bitmap, F.shiftright(h.bitwiseAND(F.lit(mask - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _best(rows: DataFrame, known: DataFrame, ks: list[int], longest: int, shingles_n: int) -> DataFrame:
    """_key, _text_hash, item, start, hamming, similarity of the windows that hold items. rows: _key, _text_hash, k, total, all."""
    places = known.select("n", "k", F.size("hashes").alias("m"), F.posexplode("hashes").alias("at", "h"))
    anchors = places.select("n", "k", "m", "h", F.explode(F.array_distinct(F.array(F.col("at"), F.lit(0), F.col("m") - 1))).alias("at")).distinct()
    tests = {k: _bitmap(anchors.where(F.col("k") == k), shingles_n) for k in ks}
    chunk = max(CHUNK, 2 * longest)
    # chunks: the core's first place, the margin's first place, and the hashes from there to the margin behind
    first = lambda c: F.greatest(F.lit(0), c - F.lit(longest))
    cut = F.when(F.col("total") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(chunk)), lambda c: F.struct(c.alias("core"), first(c).alias("low"), F.slice("all", first(c) + 1, F.lit(chunk + longest) + c - first(c)).alias("some"))))
    rows = rows.select("_key", "_text_hash", "k", "total", F.explode(cut).alias("c")).select("_key", "_text_hash", "k", "total", "c.*")
    known_at = lambda k: F.filter(F.transform("some", lambda h, i: F.when(tests[k](h), F.col("low") + i)), lambda p: p.isNotNull())
    rows = rows.withColumn("hits", reduce(lambda rest, k: F.when(F.col("k") == k, known_at(k)).otherwise(rest), ks[1:], known_at(ks[0])))
    rows = rows.select("*", F.explode(F.filter("hits", lambda p: (p >= F.col("core")) & (p < F.col("core") + chunk))).alias("p")).withColumn("h", F.get("some", F.col("p") - F.col("low")))
    rows = rows.join(F.broadcast(anchors), ["k", "h"])
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("at"), F.col("total") - F.col("m")))
    rows = rows.withColumns({"start": start, "size": F.least("m", "total")})
    # of a window that is similar, so many shingles at least are the item's, and so pass the test
    inside = F.size(F.filter("hits", lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("size"))))
    rows = rows.where(inside >= (F.col("m") + F.col("size")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    rows = rows.select("_key", "_text_hash", "k", "n", "start", F.slice("some", F.col("start") - F.col("low") + 1, F.col("m")).alias("hashes"))
    by = ["_key", "_text_hash", "k", "n", "start"]
    windows = _fingerprints(rows.groupBy(*by).agg(F.first("hashes").alias("hashes")), by)
    marked = _fingerprints(known.withColumn("row", F.xxhash64("hashes")).dropDuplicates(["item", "k", "n", "row"]), ["item", "k", "n", "row"])
    near = json.dumps(_neighbours())
    blocks = marked.select("k", "n", "item", "row", F.col("fp").alias("item_fp"), F.explode(F.from_json(F.lit(near), "array<struct<b:int,flip:int>>")).alias("f"))
    value = reduce(lambda rest, b: F.when(F.col("f.b") == b, _block(F.col("item_fp"), b)).otherwise(rest), range(BLOCKS), F.lit(0))
    blocks = blocks.select("k", "n", "item", "row", "item_fp", F.col("f.b").alias("b"), value.bitwiseXOR(F.col("f.flip")).alias("v"))
    dealt = windows.select(*by, "hashes", "fp", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])).alias("x")).select(*by, "hashes", "fp", "x.b", "x.v")
    pairs = dealt.join(F.broadcast(blocks), ["k", "n", "b", "v"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    # of the blocks in which a pair meets, the first stands for it
    alike = [(_block(F.col("fp").bitwiseXOR(F.col("item_fp")), b)) for b in range(BLOCKS)]
    meets = F.array_position(F.transform(F.array(*alike), lambda v: F.bit_count(v) <= RADIUS // BLOCKS), True) - 1
    pairs = pairs.where((F.col("hamming") <= RADIUS) & (F.col("b") == meets)).select(*by, "hashes", "item", "row", "hamming")
    pairs = pairs.join(F.broadcast(marked.select("item", "row", "k", "n", F.col("hashes").alias("item_hashes"))), ["item", "row", "k", "n"])
    shared = F.size(F.array_intersect(counted(F.col("hashes")), counted(F.col("item_hashes"))))
    pairs = pairs.withColumn("similarity", shared / (F.size("hashes") + F.size("item_hashes") - shared))
    return pairs.where(F.col("similarity") >= SIMILARITY).select("_key", "_text_hash", "item", "start", "hamming", "similarity")


def _fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, hashes and fp, the SimHash of hashes, from sums of two bits at a time. Rows grouped by `by` already need no exchange."""
    lanes = 0x0000000100000001
    each = rows.select(*by, "hashes", F.explode("hashes").alias("h"))
    sums = each.groupBy(*by).agg(F.first("hashes").alias("hashes"), F.count("*").alias("m"), *[F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(lanes))).alias(f"s{j}") for j in range(32)])
    return sums.select(*by, "hashes", _majority(sums).alias("fp"))


def _majority(sums: DataFrame) -> Column:
    bits = []
    for j in range(32):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{j}", 32)
        bits += [F.when(2 * low > F.col("m"), F.lit(1 << j)).otherwise(F.lit(0)), F.when(2 * high > F.col("m"), F.lit((1 << (j + 32)) - (1 << 64 if j == 31 else 0))).otherwise(F.lit(0))]
    return reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits])


def _neighbours() -> list[dict]:
    """For each block, the changes by which a value RADIUS // BLOCKS bits off at most is reached."""
    near = RADIUS // BLOCKS
    return [{"b": b, "flip": x} for b in range(BLOCKS) for x in range(1 << BLOCK_BITS) if x.bit_count() <= near]


def clean(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that leak, all columns as they were."""
    bad = found.select(F.col(key).alias("_bad_key"), F.col("_text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad_key"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["_bad_hash"]), "left_anti")
