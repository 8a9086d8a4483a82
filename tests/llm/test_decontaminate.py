import random
import re
from collections import Counter

from plansift.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def best(doc, item, any_start=True):
    """The best similarity of any window of the item's size."""
    x, y = words(doc), words(item)
    if not x or not y:
        return 0.0
    k, n = min(D.WORDS, len(y)), len(y)
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    b = grams(y)
    out = 0.0
    for s in range(max(1, len(x) - n + 1)):
        a = grams(x[s : s + n])
        out = max(out, sum((a & b).values()) / sum((a | b).values()))
    return out


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[at] = f"new{rng.randrange(99)}"
        elif kind == 1:
            w.insert(at, f"new{rng.randrange(99)}")
        elif len(w) > 1:
            del w[at]
    return w


def test_against_all_windows(spark):
    rng = random.Random(8)
    vocab = [f"w{k}é" for k in range(60)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [" ".join(some(n)) for n in (1, 3, 5, 6, 20, 30, 45, 60, 80, 120)] + ["same same same same same same same same"]
    items = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, "!! ..."), (4, texts[5]), (5, texts[5])]
    docs = [(None, " ".join(some(30))), (1, None), (1, ""), (2, "...")]
    for k in range(150):
        inner = edited(rng, words(rng.choice(texts)), rng.choice([0, 0, 0, 1, 1, 2, 5]))
        docs.append((k % 140, " ".join(some(rng.randrange(0, 60)) + inner + some(rng.randrange(0, 60))).replace(" ", rng.choice([" ", ", ", "\n"])).upper()))
    docs += [(200, docs[10][1]), (201, "same " * 300), (201, "same " * 300)]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item string")
    found = D.leaks(df, spark.createDataFrame(items, "item_id int, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    want = {}
    for d, t in docs:
        for i, it in items:
            if (s := best(t, it)) >= D.SIMILARITY:
                want[d, i] = max(s, want.get((d, i), 0))
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert all(0 <= r["hamming"] <= D.RADIUS for r in found.collect())
    kept = D.clean(df, D.leaks(df, spark.createDataFrame(items, "item_id int, text string")))
    clean = [(d, t) for d, t in docs if not any(best(t, it) >= D.SIMILARITY for _, it in items)]
    assert kept.columns == df.columns and sorted(((r["doc_id"] or -1, r["text"] or "") for r in kept.collect())) == sorted((d or -1, t or "") for d, t in clean)


def test_long_documents_and_a_benchmark_in_portions(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 64)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 1 << 18)
    rng = random.Random(11)
    some = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, " ".join(some(n))) for k, n in enumerate([2, 5, 30, 60, 61, 64, 90, 100, 40, 33])]
    docs = []
    for k in range(12):
        parts = [some(rng.randrange(3000))]
        for _, t in rng.sample(items, 4):
            parts += [edited(rng, t.split(), rng.choice([0, 1])), some(rng.randrange(400))]
        docs.append((k, " ".join(w for p in parts for w in p)))
    docs.append((99, " ".join(some(60_000)) + " " + items[7][1]))
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    want = {(d, i): s for d, t in docs[:-1] for i, it in items if (s := best(t, it)) >= D.SIMILARITY}
    long = {k[1]: v for k, v in got.items() if k[0] == 99}
    assert {k: v for k, v in got.items() if k[0] != 99} == want and long[7] == 1.0 and set(long) <= {0, 7}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id int, text string")
    assert D.leaks(docs.limit(0), items).collect() == [] == D.leaks(docs, items.limit(0)).collect()
    assert [r["similarity"] for r in D.leaks(docs, items).collect()] == [1.0]


def test_query(spark):
    from plansift.llm.queries import op2_decontamination

    sf_dir = "/root/testdata/sf0.01"
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op2_decontamination(spark, sf_dir).collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    index = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 4):
            index.setdefault(tuple(w[k : k + 5]), set()).add(i)
    want = {}
    for d, t in docs:
        w = words(t)
        for i in set().union(*[index.get(tuple(w[k : k + 5]), set()) for k in range(len(w) - 4)] or [set()]):
            if (s := best(t, dict(items)[i])) >= D.SIMILARITY:
                want[d, i] = s
    assert found == want and want


def test_deletions_and_insertions_that_make_up_for_each_other(spark):
    rng = random.Random(5)
    docs, items = [], []
    for k in range(120):
        w = [f"v{rng.randrange(10**6)}" for _ in range(100)]
        items.append((k, " ".join(w)))
        a, b = ((5, 94), (8, 92), (10, 95))[k % 3]
        docs.append((k, " ".join([f"a{i}" for i in range(9)] + w[:a] + w[a + 2 : b + 2] + ["new1", "new2"] + w[b + 2 :] + [f"z{i}" for i in range(9)])))
    assert all(best(d, t) >= D.SIMILARITY for (_, d), (_, t) in zip(docs, items, strict=True))
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    assert got == {(k, k): best(docs[k][1], items[k][1]) for k in range(len(docs))}
