import random
import re

import numpy as np
import xxhash

from plansift.llm import simhash
from plansift.llm.common import labelled


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in fps:
        for y in fps:
            if bin(x ^ y).count("1") <= radius:
                root[find(x)] = find(y)
    return {x: find(x) for x in fps}


def test_fingerprint():
    rng = random.Random(2)
    for text in ["", " \n", "One", "one TWO", "a b c", "a b c d", "a b c d e", "É Ünder x\x0bY\x1cz"] + [" ".join(rng.choice("ab cd EF é".split()) for _ in range(n)) for n in range(60)]:
        assert simhash.fingerprint(text) == plain(text), repr(text)


def near(rng, n, crowd):
    base = [rng.getrandbits(64) for _ in range(n)]
    out = list(base)
    for x in base[: n // 2]:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            out.append(x)
    centre = rng.getrandbits(64)
    out += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(crowd)]
    return out


def test_links_keep_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 20)
    fps = list(dict.fromkeys(near(random.Random(3), 120, 150)))
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    found = {int(np.int64(r["fp"]).view(np.uint64)): r["label"] for r in labelled(nodes, "fp", simhash.links(nodes)).collect()}
    want = classes(fps, 4)
    pairs = {(want[x], found[x]) for x in fps}
    assert len(found) == len(fps) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_a_long_chain(spark):
    nodes = spark.range(400)
    found = labelled(nodes, "id", spark.range(399).selectExpr("id a", "id + 1 b").where("a <> 200")).collect()
    assert {len({r["label"] for r in found if (r["id"] <= 200) == side}) for side in (True, False)} == {1}
    assert len({r["label"] for r in found}) == 2


def test_near_duplicates_of_odd_rows(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(40)) for _ in range(900))
    rows = [(5, "", "e"), (3, None, "f"), (9, " \n", "g"), (12, long, "h"), (11, long + " tail", "i"), (11, long, "j"), (None, long, "k"), (20, "one two three", "l"), (21, "ONE two\tthree", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    want = classes([plain(t) for _, t, _ in rows], 4)
    least = {}
    for key, text, _ in rows:
        least.setdefault(want[plain(text)], []).append(key)
    assert sorted(((r["doc_id"] or -1), r["component_id"]) for r in found) == sorted((k or -1, min(x for x in least[want[plain(t)]] if x is not None)) for k, t, _ in rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_query(spark, sf_dir):
    from plansift.llm.queries import op7_simhash

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {k: plain(t) for k, t in docs.items()}
    want = classes(list(fps.values()), 4)
    for r in op7_simhash(spark, sf_dir).collect():
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == min(k for k in docs if want[fps[k]] == want[fps[r["doc_id"]]])


def test_crowded_buckets_are_dealt_again_and_one_may_be_all_there_is(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(4)
    flips = [sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(60)]
    fps = sorted({f ^ g for f in (0, (1 << 63) - 1) for g in flips} | {int(x) for x in rng.integers(0, 1 << 62, 20)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    near = list(map(bytes, simhash.pivot_table(np.array(fps).view(np.uint64), simhash.pivots())))
    frame = pd.DataFrame({"pair": 1, "bucket": 7, "fp": fps, "near": near})
    assert len(pd.concat(simhash._verified(4, most=8)(iter([frame[:50], frame[50:]]))))
    monkeypatch.setattr(simhash, "CROWDED", 4)
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    far = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()

    def parts(pairs):
        of = {f: f for f in fps}
        for a, b in pairs:
            x, y = of[a], of[b]
            of = {f: x if g == y else g for f, g in of.items()}
        return {frozenset(f for f in fps if of[f] == g) for g in of.values()}

    assert parts((r["a"], r["b"]) for r in found) == parts((a, b) for a in fps for b in fps if a < b and far(a, b) <= 4)
