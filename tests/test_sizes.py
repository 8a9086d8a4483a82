"""Larger tables than the test data's: keys beyond its range, pages of very many tiles."""

import os
import re
import tracemalloc

import numpy as np
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from plansift import catalog, catalog_pages  # noqa: F401
from plansift.llm import bpe
from plansift.operators import geometry, profile
from plansift.plans import adapters
from plansift.sources import shared, tiles
from plansift.sources.shared import stored
from tests.oracle import compare


def with_keys(spark, sf_dir, tmp_path, table, key, keys):
    """A copy of the tables in which `table` has one row for each of the keys."""
    for name in os.listdir(sf_dir):
        if name != f"{table}.parquet":
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    own = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    one = own.limit(1).drop(key)
    one.crossJoin(spark.createDataFrame([(k,) for k in keys], f"{key} long")).select(*own.columns).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_tokens_of_long_numbers(spark, sf_dir, tmp_path):
    d = with_keys(spark, sf_dir, tmp_path, "supplier", "s_suppkey", [0, 7, 99, 999, 1000, 1001, 59999])
    compare(catalog.QUERIES["token_texts"](spark, d), catalog.ORACLE_SQL["token_texts"], d)


def test_passes_of_large_pages(spark, sf_dir, tmp_path):
    d = with_keys(spark, sf_dir, tmp_path, "supplier", "s_suppkey", [0, 1, 5, 500_000, 500_003])
    compare(catalog.QUERIES["ocr_passes"](spark, d), catalog.ORACLE_SQL["ocr_passes"], d)


def test_pass_counts_are_those_of_the_rows(spark):
    sizes = [(w, h, a, b) for w in (0, 1, 1519, 1520, 1521, 1700, 1701, 3220, 3221, 9000) for h in (1, 660, 1700, 3041, 4741) for a, b in ((0, 20), (5, 3), (None, 10))]
    pages = spark.createDataFrame([(k, *s) for k, s in enumerate(sizes)], "page int, width int, height int, important_a int, important_b int")
    want = {(r["page"], r["pass"]): r["count"] for r in tiles.passes(pages).groupBy("page", "pass").count().collect()}
    for r in tiles.pass_counts(pages).collect():
        assert [r[c.lower()] for c in "ABCD"] == [want.get((r["page"], c), 0) for c in "ABCD"]


def test_tiles_of_few_large_pages_are_dealt_out(spark):
    pages = spark.range(64).coalesce(1).select(F.col("id"), F.lit(40_000).alias("width"), F.lit(40_000).alias("height"))
    own = tiles.tiles(pages).groupBy(F.spark_partition_id()).count().collect()
    assert len(own) > 4 and sum(r["count"] for r in own) == 64 * 27 * 27


def test_tiles_are_made_row_by_row_of_a_page(spark):
    """One compiled stage with both explodes holds all tiles of a page at once."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = tiles.tiles(spark.range(3).selectExpr("id", "id * 70 AS width", "id * 41 AS height"))
        stages = re.findall(r"\*\((\d+)\) Generate", made._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert len(stages) == 2 and len(set(stages)) == 2


def test_tiles_start_at_all_steps_and_at_the_end(spark):
    sizes = [0, 1, 899, 1700, 1701, 3219, 3220, 3221, 4740, 9000]
    pages = spark.createDataFrame([(k, w, h) for k, (w, h) in enumerate((w, h) for w in sizes for h in sizes)], "id int, width int, height int")
    for tile, overlap in ((1700, 180), (900, 0), (300, 240)):
        starts = lambda n: {min(s, max(n - tile, 0)) for s in range(0, max(n, 1), tile - overlap)}  # noqa: B023, E731
        few = pages.where("width <= 1701 AND height <= 1701") if tile == 300 else pages
        got = sorted(map(tuple, tiles.tiles(few, tile, overlap).collect()))
        assert got == sorted((*r, y, x, min(tile, r["width"]), min(tile, r["height"])) for r in few.collect() for y in starts(r["height"]) for x in starts(r["width"]))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_pages_of_one_file_are_dealt_out(spark, sf_dir):
    assert adapters.drawn_words(spark, sf_dir).rdd.getNumPartitions() >= 4
    assert adapters.sheets(spark, sf_dir)[1].rdd.getNumPartitions() >= 4


def test_columns_are_made_from_stored_words(spark, sf_dir):
    assert "c_custkey" not in plan(catalog.QUERIES["column_rows"](spark, sf_dir))


def test_plan_of_elevations_does_not_repeat_its_input(spark, sf_dir):
    words = stored(adapters.drawn_words(spark, sf_dir), "words")
    anchors = stored(profile.with_tolerance(geometry.exact_labels(words, profile=True)), "anchors")
    assert len(plan(profile.elevations(anchors, words))) < 20_000


def test_gathered_places_take_two_arrays_at_most():
    at = np.arange(1000)
    tracemalloc.start()
    bpe.gather(np.zeros(4_000_000, np.uint8), np.full(1000, 4000), at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.4 * 8 * 4_000_000


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_a_stored_step_leaves_no_garbage_in_a_full_heap(spark, monkeypatch):
    for full, least, most in ((0.0, 1, 99), (1.0, 0, 0)):
        monkeypatch.setattr(shared, "FULL", full)
        before = collections(spark)
        stored(spark.range(3).toDF("id"), "few")
        assert least <= collections(spark) - before <= most


def test_last_plan_of_whole_pages_is_the_merge_alone(spark, sf_dir):
    df = catalog.QUERIES["spatial_manholes"](spark, sf_dir)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 15
    assert df.count() == 487


def test_steps_of_whole_pages_are_planned_once(spark, sf_dir, monkeypatch):
    keys = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before, write, seen = [spark.conf.get(k, None) for k in keys], DataFrameWriter.parquet, []

    def noted(self, path, *args, **more):
        seen.append((path.rsplit("/", 1)[-1][:-33], [spark.conf.get(k) for k in keys]))
        return write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    catalog.QUERIES["spatial_manholes"](spark, sf_dir)
    assert {"words", "anchors", "text-only", "text-manholes", "page-rows"} <= {name for name, _ in seen}
    assert all(conf == ["false", "-1"] for _, conf in seen)
    assert [spark.conf.get(k, None) for k in keys] == before
