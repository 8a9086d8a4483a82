import pytest
from pyspark.sql import functions as F

from plansift import catalog, catalog_pages  # noqa: F401
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        compare(df, catalog.ORACLE_SQL[name], sf_dir)
    else:
        assert df.count() > 0


def test_every_order_is_parsed(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = catalog.QUERIES["decimal_parse"](spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    compare(found, catalog.ORACLE_SQL["decimal_parse"], sf_dir)


def test_words_of_every_document(spark, tmp_path):
    texts = ["  led by blanks", "a\nline feed first", "\n", "", "long " * 400 + "end", "one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["first_word"], r["n"]) for r in catalog.QUERIES["chars_to_words"](spark, str(tmp_path)).collect()}
    assert found == {k: (t.split()[0], len(t.split())) for k, t in enumerate(texts) if t.split()}


def test_copies_are_looked_up(spark, tmp_path):
    texts = {1: "a", 6: "b", 7: "b", 8: "a", 12: "c", 13: "d", 14: "b"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["hit"] for r in catalog.QUERIES["cache_lookup"](spark, str(tmp_path)).collect()}
    assert found == {k: t in "bc" for k, t in texts.items()}
