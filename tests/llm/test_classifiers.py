import random
import tracemalloc
import zlib

import numpy as np
import pytest

from plansift.llm import quality, toxicity


def corpus(seed, n, toxic_share):
    rng = random.Random(seed)
    plain, bad = [f"w{k}" for k in range(400)], ["vile", "rotten", "nasty", "grim"]
    out = []
    for _ in range(n):
        y = rng.random() < toxic_share
        out.append((" ".join(rng.choice(bad) if y and rng.random() < 0.08 else rng.choice(plain) for _ in range(rng.randrange(30, 200))), int(y)))
    return out


def test_pu_learning_from_positive_and_unlabelled_texts():
    known, mixed, test = corpus(1, 300, 1.0), corpus(2, 1500, 0.2), corpus(3, 500, 0.2)
    model = toxicity.fit([t for t, _ in known], [t for t, _ in mixed], 0.2)
    words = {}
    right = [(model.score(t, words) >= 0.3) == y for t, y in test]
    assert np.mean(right) > 0.95


def test_a_fit_takes_little_beside_its_features():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(1500)]
    size = sum(x.nbytes for x in toxicity._rows(texts)[0])
    tracemalloc.start()
    ids, _ = toxicity._rows(texts)
    known = tracemalloc.get_traced_memory()[1] - size
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    toxicity.chosen(ids[:500], ids[500:])
    counts = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert known < 15_000_000 and counts < 8 * 8 * (1 << toxicity.BITS)


def test_prior_without_examples():
    assert toxicity.fit([], ["a"], 0.3).score("", {}) < 0.01
    assert abs(toxicity.fit(["a"], [], 0.3).score("", {}) - 0.3) < 1e-6


def test_passages():
    rng = random.Random(0)
    texts = ["", " ", "One", "ÉA b\tc!! c c |", " ".join(rng.choice(["ab", "Cd.", "e#", "12"]) for _ in range(300)), "x" * 5000]
    x, counts = quality.passages(texts)
    assert counts.tolist() == [1, 1, 1, 1, 5, 1] and len(x) == 10 and np.isfinite(x).all()
    each = [quality.passages([t])[0] for t in texts]
    assert np.allclose(x, np.concatenate(each))
    words = texts[4].split()[64:128]
    assert np.isclose(x[5, -9], len({w.lower() for w in words}) / 64)
    assert np.isclose(x[5, -8], sum(a == b for a, b in zip(words[1:], words)) / 64)
    assert np.isclose(x[5, -7], sum(map(len, words)) / 640)
    assert quality.passages([])[0].shape == (0, quality.FEATURES)


def test_gradient_of_the_attention():
    rng = np.random.default_rng(0)
    texts = ["One two three. " * 60, "x y", "c D!! " * 200, "1 | 2"]
    model = quality.fit(texts, [1, 0, 0, 1], epochs=2)
    x, counts = quality.passages(texts)
    y = np.array([1.0, 0.0, 0.0, 1.0])
    _, kept = model.forward(x, counts)
    assert np.allclose(np.add.reduceat(kept["a"], kept["at"]), 1)
    _, grads = model.gradients(x, counts, y)
    for part, grad in zip(model.parts, grads, strict=True):
        for at in rng.choice(part.size, min(part.size, 12), replace=False):
            place = np.unravel_index(at, part.shape)
            before, found = part[place], []
            for step in (1e-5, -1e-5):
                part[place] = before + step
                found.append(model.gradients(x, counts, y)[0])
            part[place] = before
            assert np.isclose((found[0] - found[1]) / 2e-5, grad[place], rtol=1e-4, atol=1e-8)


def test_long_texts_in_slices(monkeypatch):
    rng = random.Random(2)
    texts = [" \n" + " ".join(rng.choice(["ab", "Cd.", "e#\n", "12", "ab"]) for _ in range(n)) for n in (0, 1, 64, 65, 1000, 1280, 3)] + ["x" * 3000, "y " * 700 + "z" * 2000 + " end"]
    whole = quality.passages(texts)
    monkeypatch.setattr(quality, "SLICE", 300)
    sliced = quality.passages(texts)
    assert (whole[1] == sliced[1]).all() and np.allclose(whole[0], sliced[0])


@pytest.mark.parametrize("shift,clamped", [(2.0, False), (-6.0, True)])
def test_slopes_of_the_non_negative_risk(shift, clamped):
    rng = np.random.default_rng(1)
    gp, gu, prior = rng.normal(2, 1, 7), rng.normal(shift, 1, 11), 0.4
    loss = lambda g: np.logaddexp(0, -g).mean()
    negative = lambda p, u: loss(-u) - prior * loss(-p)
    assert (negative(gp, gu) < 0) == clamped
    aim = (lambda p, u: -negative(p, u)) if clamped else (lambda p, u: prior * loss(p) + negative(p, u))
    dp, du, told = toxicity.risk_slopes(gp, gu, prior)
    assert told == clamped
    for g, d, f in ((gp, dp, lambda x: aim(x, gu)), (gu, du, lambda x: aim(gp, x))):
        for k in range(len(g)):
            e = np.zeros(len(g))
            e[k] = 1e-5
            assert np.isclose((f(g + e) - f(g - e)) / 2e-5, d[k], atol=1e-8)


@pytest.mark.parametrize("share", [0.05, 0.2, 0.5])
def test_prior_from_positive_and_unlabelled_texts(share):
    known, mixed = corpus(7, 400, 1.0), corpus(8, 3000, share)
    found = toxicity.estimated_prior(*(toxicity._rows([t for t, _ in rows]) for rows in (known, mixed)))
    assert abs(found - np.mean([y for _, y in mixed])) < 0.3 * share + 0.01


def test_multiple_instances():
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "again", "Then", "came."]) for _ in range(200))
    junk = lambda: good() + " " + "SPAM!! " * 80
    rows = [(good(), 1) if rng.random() < 0.6 else (junk(), 0) for _ in range(300)]
    model = quality.fit([t for t, _ in rows[:200]], [y for _, y in rows[:200]])
    assert np.mean((model.score([t for t, _ in rows[200:]]) >= 0.5) == [y for _, y in rows[200:]]) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    docs = spark.createDataFrame([(1, None, "e"), (None, "", "f"), (2, "word " * 50_000, "g"), (2, "word", "h"), (2, "word", "h")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    for some in (docs, docs.limit(0)):
        for known in (labels, labels.limit(0)):
            found = module.score(some, module.learned(some, known)).collect()
            assert len(found) == some.count() and all(0 <= r["score"] <= 1 for r in found)


@pytest.mark.parametrize("name,column,folds,at", [("op4_toxicity", "toxic", 4, 2), ("op10_quality", "quality", 3, 1)])
def test_held_out_accuracy(spark, name, column, folds, at):
    from plansift.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    y = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in y]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == at) for r in rows)
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.92
