"""Comparison of merged manholes with an expected list; nothing is filled in from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.functions import rules, text

HEIGHT_TOLERANCE = 0.05


def compared(actual: DataFrame, expected: DataFrame, order: str = "ordinal") -> DataFrame:
    """A row per expected id: found, and whether diameter, height, type and crown agree. actual: the first row per id counts."""
    first = actual.withColumn("id", text.key_of(F.col("identifier"))).where("id <> ''").groupBy("id").agg(F.min_by(F.struct("diameter_mm", "height_m", "type", "crown"), order).alias("a"))
    rows = expected.join(first, "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "id",
        F.col("a").isNotNull().alias("found"),
        yes(F.col("a.diameter_mm") == F.col("dn")).alias("dn_ok"),
        yes(F.abs(F.col("a.height_m") - F.col("height")) <= HEIGHT_TOLERANCE).alias("height_ok"),
        yes(F.col("a").isNotNull() & rules.equivalent_type(text.folded(F.col("a.type")), text.folded(F.col("type")))).alias("type_ok"),
        yes(F.col("a").isNotNull() & rules.equivalent_crown(text.folded(F.col("a.crown")), text.folded(F.col("crown")))).alias("crown_ok"),
    )


def extras(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Identifiers that aren't expected."""
    ids = actual.select(text.key_of(F.col("identifier")).alias("id")).where("id <> ''").distinct()
    return ids.join(expected.select("id"), "id", "left_anti")


def lacking(actual: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.select("id").join(actual.select(text.key_of(F.col("identifier")).alias("id")), "id", "left_anti")


def percent(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.rint(n * 100.0 / total)).otherwise(0).cast("int")


def score(actual: DataFrame, expected: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row: found, dn, height, type, crown, total, percents of them, hits of all fields, extras."""
    names = {"found": "found", "dn": "dn_ok", "height": "height_ok", "type": "type_ok", "crown": "crown_ok"}
    counts = compared(actual, expected, order).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in names.items()])
    more = extras(actual, expected).agg(F.count("*").alias("extras"))
    hits = F.col("dn") + F.col("height") + F.col("type") + F.col("crown")
    one = counts.withColumn("_one", F.lit(1)).join(more.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return one.select("*", *[percent(F.col(n), F.col("total")).alias(f"{n}_percent") for n in names], percent(hits, 4 * F.col("total")).alias("fields_percent"))
