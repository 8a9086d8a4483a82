import hashlib

import pytest

import corpus_pipeline as C
from plansift.llm import toxicity
from tests.llm.test_decontaminate import best
from tests.llm.test_simhash import classes, plain


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {k for k, r in rows.items() if model.score(r["text"], {}) < 0.3}
    out = docs
    stages = dict(C.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_level_bpe"]

    def after(name):
        nonlocal out
        out = stages[name](spark, out, sf_dir)
        path = C.stored(out, "test")
        out = path
        assert name == "byte_level_bpe" or out.columns == docs.columns
        return {r["doc_id"]: r for r in out.collect()}

    assert set(after("toxicity")) == kept
    fps = {k: plain(rows[k]["text"]) for k in kept}
    groups = classes(list(fps.values()), 4)
    least = {}
    for k in sorted(kept):
        least.setdefault(groups[fps[k]], k)
    kept = set(least.values())
    assert set(after("simhash_near_dedup")) == kept
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {k for k in kept if not any(best(rows[k]["text"], t) >= 0.8 for t in items if any(w in rows[k]["text"].lower() for w in [t.split()[-2].lower().strip(".,")]))}
    found = after("benchmark_decontamination")
    assert set(found) == kept
    clean = after("secret_scans")
    assert set(clean) == kept and all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert all(clean[k]["text"] == rows[k]["text"] or "[secret]" in clean[k]["text"] for k in kept)
    last = after("byte_level_bpe")
    assert set(last) == kept and all(r["decoded_sha256"] == hashlib.sha256(clean[k]["text"].encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"] for k, r in last.items())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in C.run(spark, sf_dir).collect()) == sorted((k, r["ids_sha256"]) for k, r in last.items())


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, sf_dir, empty):
    rows = [(None, None, "en", None, None, 1), (None, "", "en", "s", 0, 1), (7, "one two", None, "s", 7, 1), (7, "one two", None, "s", 7, 1), (7, "quite another text it is", "de", "s", 3, 2), (8, "ONE two", "en", "s", 7, 1), (9, "password=3d4bc476f7469ffa8a is " + "the word " * 40_000, "en", "s", 7, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    docs = docs.limit(0) if empty else docs
    for k, (_, stage) in enumerate(C.STAGES):
        docs = C.stored(stage(spark, docs, sf_dir), "test")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == ([] if empty else [0, 7, 7, 9])
