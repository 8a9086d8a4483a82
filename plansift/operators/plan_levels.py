"""Elevations written beside the nodes of site plans: which two numbers belong to which label.

Candidates are spatial joins; who gets what is a one-to-one match in a fixed order, folded page by page over a sorted array. Fixed
values: reaches, weights and limits of the costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.functions import rules, text
from plansift.operators.geometry import PAGE, centred, near_join
from plansift.operators.rows import greedy_matches


def numbers(words: DataFrame) -> DataFrame:
    """Words that are elevations: page, idx, x, y (centres), value, and plain, the value without what is put right in reading it."""
    w = centred(words).withColumns({"value": rules.elevation(F.col("text")), "plain": rules.number_or_zero(F.trim("text"))})
    return w.where("value IS NOT NULL").select(*PAGE, "idx", F.col("cx").alias("x"), F.col("cy").alias("y"), "value", "plain")


def _apart(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def ordered_edges(anchors: DataFrame, levels: DataFrame) -> DataFrame:
    """page, anchor, turn, a, b, cost, ground_m, invert_m: pairs of numbers that stand near a label in the drawing and in its stream.

    A pair lies in a row or a stack; its cost is mostly its distance in the stream, then that on the page. anchors: idx, source_idx, x, y.
    """
    near = near_join(anchors.select(*PAGE, "idx", "source_idx", "x", "y"), levels.drop("value"), 120.0, 85.0, lx="x", ly="y", rx="x", ry="y")
    near = near.where(F.abs(F.col("r_idx") - F.col("source_idx")) <= 10)
    one = near.select(*PAGE, "idx", "source_idx", "x", "y", *[F.col(f"r_{c}").alias(f"a_{c}") for c in ("idx", "x", "y", "plain")])
    two = near.select(*PAGE, "idx", *[F.col(f"r_{c}").alias(f"b_{c}") for c in ("idx", "x", "y", "plain")])
    pairs = one.join(two, [*PAGE, "idx"]).where((F.col("a_idx") < F.col("b_idx")) & _apart("a_plain", "b_plain").between(0.2, 15))
    dx, dy = _apart("a_x", "b_x"), _apart("a_y", "b_y")
    pairs = pairs.where(((dy <= 14) & (dx <= 85)) | ((dx <= 20) & (dy <= 42)))
    off_x, off_y = F.abs((F.col("a_x") + F.col("b_x")) / 2 - F.col("x")), F.abs((F.col("a_y") + F.col("b_y")) / 2 - F.col("y"))
    cost = 18.0 * (_apart("a_idx", "source_idx") + _apart("b_idx", "source_idx")) + off_x + 3 * off_y + 0.2 * dx + 0.6 * dy
    out = pairs.select(*PAGE, F.col("idx").alias("anchor"), F.col("source_idx").alias("turn"), F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), cost.alias("cost"), F.greatest("a_plain", "b_plain").alias("ground_m"), F.least("a_plain", "b_plain").alias("invert_m"))
    return out.where((F.col("cost") > 0) & (F.col("cost") <= 520))


def level_pairs(levels: DataFrame) -> DataFrame:
    """page, a, b, x, y, level, ground_m, invert_m: numbers .20 to 15 m apart in a stack or (level) in a row."""
    pairs = near_join(levels, levels, 70.0, 34.0, lx="x", ly="y", rx="x", ry="y").where((F.col("idx") < F.col("r_idx")) & _apart("value", "r_value").between(0.2, 15))
    dx, dy = _apart("x", "r_x"), _apart("y", "r_y")
    row = (dy <= 12) & (dx <= 70)
    pairs = pairs.where(row | ((dx <= 18) & (dy <= 34)))
    return pairs.select(*PAGE, F.col("idx").alias("a"), F.col("r_idx").alias("b"), ((F.col("x") + F.col("r_x")) / 2).alias("x"), ((F.col("y") + F.col("r_y")) / 2).alias("y"), row.alias("level"), F.greatest("value", "r_value").alias("ground_m"), F.least("value", "r_value").alias("invert_m"))


def spatial_edges(anchors: DataFrame, levels: DataFrame) -> DataFrame:
    """page, anchor, a, b, cost, ground_m, invert_m: labels and the pairs of numbers close beside, below or above them."""
    pairs = level_pairs(levels)
    near = near_join(anchors.select(*PAGE, "idx", "x", "y"), pairs, 85.0, 58.0, lx="x", ly="y", rx="x", ry="y")
    dx, dy = _apart("x", "r_x"), _apart("y", "r_y")
    near = near.where(F.when(F.col("r_level"), (dx <= 85) & (dy <= 18)).otherwise((dx <= 32) & (dy <= 58)))
    cost = 1.5 * dx + 5.0 * dy - F.when(F.col("r_level"), 6.0).otherwise(0.0)
    return near.select(*PAGE, F.col("idx").alias("anchor"), F.col("r_a").alias("a"), F.col("r_b").alias("b"), cost.alias("cost"), F.col("r_ground_m").alias("ground_m"), F.col("r_invert_m").alias("invert_m"))


def _levels_of(edges: DataFrame, order: list[str]) -> DataFrame:
    kept = greedy_matches(edges, order=order)
    return kept.join(edges, [*PAGE, "anchor", "a", "b"]).select(*PAGE, F.col("anchor").alias("idx"), "ground_m", "invert_m")


def ordered_levels(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """page, idx, ground_m, invert_m: labels in the order of the stream, each with its cheapest pair of numbers not yet in use."""
    return _levels_of(ordered_edges(anchors, numbers(words)), ["turn", "anchor", "cost", "a", "b"])


def spatial_levels(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """page, idx, ground_m, invert_m: the cheapest pairs of the whole page first, each label and number once."""
    edges = spatial_edges(anchors, numbers(words)).where("cost <= 260")
    return _levels_of(edges, ["cost", "a", "b", "anchor"])


def has_doubled_glyphs(words: DataFrame) -> DataFrame:
    """page, doubled: whether any word's characters all come twice."""
    return words.groupBy(*PAGE).agg(F.bool_or(text.halved(F.col("text")) != F.trim("text")).alias("doubled"))
