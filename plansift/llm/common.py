"""What several corpus operators share: intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.sources.shared import discard, last_stored, scratch, shared_dir, shared_path, stored, table

__all__ = ["discard", "labelled", "last_stored", "partitions", "rounds_of_links", "scratch", "shared_dir", "shared_path", "stored", "table"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rounds_of_links(links: DataFrame) -> list[DataFrame]:
    """The maps (node, label) by which components contract, one per round; composed, they lead every node of a component to one label.

    links: columns a, b (long). In each round, every node points to the neighbour (or itself) that is least by a hash, follows one
    more pointer, and links are renamed and made distinct. Pointers fall in the hash's order, so they can't form a cycle, and a
    constant share of the nodes goes in each round, whatever the diameter. Only aggregates and equi joins, each with map-side
    combining or a join that adaptive execution can split, so a hub costs no single task.
    """
    maps = []
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    while not links.isEmpty():
        seed = len(maps)
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("v"))
        ends = links.select(F.col("a").alias("node"), rank("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), rank("a").alias("to")))
        least = ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least(rank("node"), "to")["v"].alias("to"))
        least = stored(least, "pointers")
        on = least.select(F.col("node").alias("to"), F.col("to").alias("label"))
        maps.append(stored(least.join(on, "to").select("node", "label"), "labels"))
        for end in ("a", "b"):
            links = links.join(maps[-1].withColumnRenamed("node", end), end).drop(end).withColumnRenamed("label", end)
        links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return maps


def labelled(nodes: DataFrame, node: str, links: DataFrame, label: str = "label") -> DataFrame:
    """nodes plus a column that is the same for two rows if and only if links (a, b) connect their nodes."""
    out = nodes.withColumn(label, F.col(node))
    for k, step in enumerate(rounds_of_links(links)):
        step = step.select(F.col("node").alias(label), F.col("label").alias(f"_to{k}"))
        out = out.join(step, label, "left").withColumn(label, F.coalesce(f"_to{k}", label)).drop(f"_to{k}")
    return out
