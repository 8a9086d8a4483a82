"""Rows of points on a page: clusters in one dimension, gaps, tolerances, band pairs, and the few folds that depend on order."""

from __future__ import annotations

import statistics
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from plansift.functions import rules

PAGE = ["doc_id", "page_no"]


def upper_median(values: Column) -> Column:
    """The element n // 2 of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def clusters(values: Column, tolerance: Column) -> Column:
    """array<struct<mean, members>>: values in order, each joins the last cluster if it is at most tolerance from its running mean."""
    shape = "array<struct<mean:double,members:array<double>>>"

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        n = F.size(last["members"])
        joined = F.struct(((last["mean"] * n + v) / (n + 1)).alias("mean"), F.concat(last["members"], F.array(v)).alias("members"))
        alone = F.struct(v.alias("mean"), F.array(v).alias("members"))
        fits = (F.size(acc) > 0) & (F.abs(F.coalesce(F.try_element_at(acc, F.lit(-1))["mean"], F.lit(0.0)) - v) <= tolerance)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(alone)))

    return F.aggregate(F.array_sort(values), F.array().cast(shape), step)


def banded(points: DataFrame, value: str, tolerance: Column, by: list[str] = PAGE) -> DataFrame:
    """A row per cluster of a group: by, band (its place), mean, size. tolerance: a column constant in the group."""
    groups = points.groupBy(*by).agg(F.collect_list(F.col(value).cast("double")).alias("_v"), F.max(tolerance).cast("double").alias("_t"))
    return groups.select(*by, F.posexplode(clusters(F.col("_v"), F.col("_t"))).alias("band", "c")).select(*by, "band", F.col("c.mean").alias("mean"), F.size("c.members").alias("size"))


def gap_tolerance(points: DataFrame, x: str = "x", share: float = 0.34, low: float = 16.0, high: float = 55.0, fallback: float = 80.0, least: float = 1.0) -> DataFrame:
    """doc_id, page_no, gap, tolerance: the upper median of gaps over `least` between neighbours, and a clamped share of it."""
    w = Window.partitionBy(*PAGE).orderBy(x)
    gaps = points.withColumn("_gap", F.lead(x).over(w) - F.col(x))
    out = gaps.groupBy(*PAGE).agg(F.coalesce(upper_median(F.collect_list(F.when(F.col("_gap") > least, F.col("_gap")))), F.lit(fallback)).alias("gap"))
    return out.withColumn("tolerance", rules.clamp(share * F.col("gap"), low, high))


def sequential_links(points: DataFrame, value: str, order: list[str]) -> DataFrame:
    """links (neighbours one apart) and roughness (sum of absolute steps) along each page's row."""
    w = Window.partitionBy(*PAGE).orderBy(*order)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    return points.withColumn("_s", step).groupBy(*PAGE).agg(F.count_if(F.col("_s") == 1).alias("links"), F.coalesce(F.sum("_s"), F.lit(0)).alias("roughness"))


def band_pairs(anchors: DataFrame, points: DataFrame, low: float = 0.35, high: float = 8.0, least_hits: int = 2) -> DataFrame:
    """The best pair of bands by page: ground above invert, each anchor met by its nearest point of both within its tolerance.

    anchors: x, idx, tolerance; points: band, x, value. Per anchor and band the nearest point, then pairs of bands joined on the
    anchor: hits first, then least misalignment. Returns page, ground_band, invert_band, hits, misalignment.
    """
    p = points.select(*PAGE, "band", F.col("x").alias("px"), "value", F.col("idx").alias("pidx"))
    near = anchors.select(*PAGE, "idx", "x", "tolerance").join(p, PAGE).withColumn("dx", F.abs(F.col("px") - F.col("x"))).where(F.col("dx") <= F.col("tolerance"))
    w = Window.partitionBy(*PAGE, "idx", "band").orderBy("dx", "pidx")
    near = near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*PAGE, "idx", "band", "value", "dx")
    other = near.select(*PAGE, "idx", F.col("band").alias("invert_band"), F.col("value").alias("invert"), F.col("dx").alias("invert_dx"))
    both = near.join(other, [*PAGE, "idx"]).where((F.col("band") != F.col("invert_band")) & (F.col("value") - F.col("invert")).between(low, high))
    scored = both.groupBy(*PAGE, F.col("band").alias("ground_band"), "invert_band").agg(F.count("*").alias("hits"), F.sum(F.col("dx") + F.col("invert_dx")).alias("misalignment"))
    best = Window.partitionBy(*PAGE).orderBy(F.desc("hits"), "misalignment", "ground_band", "invert_band")
    return scored.where(F.col("hits") >= least_hits).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def band_triples(values: DataFrame, tolerance: float = 0.28) -> DataFrame:
    """The best triple of bands by page with ground - invert = depth: 70 a hit, -180 the mean residual, -.5 the mean misalignment.

    values: page, idx (anchor), kind (level or depth), band, value, dx: an anchor's nearest value in each band.
    """
    level, depth = values.where("kind = 'level'"), values.where("kind = 'depth'")
    take = lambda df, p: df.select(*PAGE, "idx", F.col("band").alias(f"{p}_band"), F.col("value").alias(p), F.col("dx").alias(f"{p}_dx"))
    rows = take(level, "g").join(take(level, "i"), [*PAGE, "idx"]).where("g > i AND g_band <> i_band").join(take(depth, "d"), [*PAGE, "idx"])
    rows = rows.withColumn("residual", F.abs(F.col("g") - F.col("i") - F.col("d"))).where(F.col("residual") <= tolerance)
    scored = rows.groupBy(*PAGE, "g_band", "i_band", "d_band").agg(F.count("*").alias("hits"), (70 * F.count("*") - 180 * F.avg("residual") - 0.5 * F.avg((F.col("g_dx") + F.col("i_dx") + F.col("d_dx")) / 3)).alias("score"))
    best = Window.partitionBy(*PAGE).orderBy(F.desc("score"), "g_band", "i_band", "d_band")
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def dominant(values: DataFrame, by: list[str], value: str, toward: int = 1200) -> DataFrame:
    """The most frequent value of each group, at a tie the one closest to `toward`, then the smaller; and its share."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    w = group.orderBy(F.desc("n"), F.abs(F.col(value) - toward), value)
    return counts.withColumns({"_n": F.row_number().over(w), "share": F.col("n") / F.sum("n").over(group)}).where("_n = 1").drop("_n")


def per_page(df: DataFrame, fold: Callable[[list[dict]], Iterator[tuple]], schema: str, by: list[str] = PAGE, order: list[str] | None = None) -> DataFrame:
    """A fold that depends on order, page by page, of as many pages as an Arrow batch holds: the rows of a page come together, sorted
    by `order`, as dictionaries; a page that goes on in the next batch waits for it."""
    sorted_ = df.repartition(*by).sortWithinPartitions(*by, *(order or []))
    shape = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded(rows: list[dict]) -> Iterator[tuple]:
            at = 0
            while at < len(rows):
                end, own = at, tuple(rows[at][c] for c in by)
                while end < len(rows) and tuple(rows[end][c] for c in by) == own:
                    end += 1
                for out in fold(rows[at:end]):
                    yield own + out
                at = end

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            found = list(folded(rows))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], shape.field(k).type) for k in range(len(shape))], schema=shape)

        open_: list[dict] = []
        for batch in batches:
            rows = open_ + batch.to_pylist()
            if not rows:
                continue
            last = tuple(rows[-1][c] for c in by)
            cut = len(rows)
            while cut and tuple(rows[cut - 1][c] for c in by) == last:
                cut -= 1
            open_ = rows[cut:]
            if cut:
                yield batch_of(rows[:cut])
        if open_:
            yield batch_of(open_)

    return sorted_.mapInArrow(run, schema)


def greedy_matches(edges: DataFrame, most: float | None = None, by: list[str] = PAGE, order: list[str] | None = None) -> DataFrame:
    """One-to-one matches of anchors and pairs of numbers: edges in order, each taken if neither its anchor nor a number is in use.

    edges: by, anchor, a, b (ids of numbers), cost and the columns of order (by cost, if not given). Edges above `most` don't count.
    Returns by, anchor, a, b, cost.
    """
    order = order or ["cost", "anchor", "a", "b"]
    some = edges if most is None else edges.where(F.col("cost") <= most)
    one = F.struct(*[F.col(c).cast("double").alias(f"o{k}") for k, c in enumerate(order)], *[F.col(c).cast("long").alias(c) for c in ("anchor", "a", "b")], F.col("cost").cast("double").alias("cost"))
    pages = some.groupBy(*by).agg(F.sort_array(F.collect_list(one)).alias("e"))
    kept = "array<struct<anchor:bigint,a:bigint,b:bigint,cost:double>>"
    none = F.array().cast("array<bigint>")

    def step(acc: Column, e: Column) -> Column:
        free = ~F.array_contains(acc["anchors"], e["anchor"]) & ~F.array_contains(acc["numbers"], e["a"]) & ~F.array_contains(acc["numbers"], e["b"])
        taken = F.struct(F.concat(acc["anchors"], F.array(e["anchor"])).alias("anchors"), F.concat(acc["numbers"], F.array(e["a"], e["b"])).alias("numbers"), F.concat(acc["kept"], F.array(F.struct(e["anchor"], e["a"], e["b"], e["cost"]))).alias("kept"))
        return F.when(free, taken).otherwise(acc)

    start = F.struct(none.alias("anchors"), none.alias("numbers"), F.array().cast(kept).alias("kept"))
    return pages.select(*by, F.explode(F.aggregate("e", start, step, lambda acc: acc["kept"])).alias("m")).select(*by, "m.anchor", "m.a", "m.b", "m.cost")


def without_repeats(words: DataFrame, important: str = "important", by: list[str] = PAGE) -> DataFrame:
    """Words read twice by OCR, once: best first, a word goes if a kept one of the same text lies within a share of its box.

    Only words of one text can be repeats of each other, so the fold runs over a page's words of a text (column key), not over the page.
    """
    rows = words.withColumns({"_cx": F.col("x") + F.col("w") / 2, "_cy": F.col("y") + F.col("h") / 2})
    one = F.struct((~F.col(important)).alias("o0"), (-F.col("confidence")).alias("o1"), F.col("idx").cast("long").alias("at"), *[F.col(c).cast("double").alias(c.strip("_")) for c in ("_cx", "_cy", "w", "h")])
    groups = rows.groupBy(*by, "key").agg(F.sort_array(F.collect_list(one)).alias("l"))
    near = lambda k, e: (F.abs(k["cx"] - e["cx"]) <= F.greatest(F.lit(16.0), 0.55 * e["w"])) & (F.abs(k["cy"] - e["cy"]) <= F.greatest(F.lit(12.0), 0.75 * e["h"]))
    step = lambda acc, e: F.when(F.exists(acc, lambda k: near(k, e)), acc).otherwise(F.concat(acc, F.array(F.struct(e["at"].alias("at"), e["cx"].alias("cx"), e["cy"].alias("cy")))))
    alone = F.aggregate("l", F.array().cast("array<struct<at:bigint,cx:double,cy:double>>"), step)
    ids = groups.select(*by, F.explode(alone).alias("k")).select(*by, F.col("k.at").alias("idx"))
    return words.join(ids, [*by, "idx"], "left_semi")


def reading_order(words: DataFrame, share: float = 0.8, least: float = 3.0, by: list[str] = PAGE) -> DataFrame:
    """by and text: words by Y put on the first line whose mean middle is within tolerance, lines by their mean Y, words by X.

    The tolerance is a share of the median height (heights below 1 count as 1). For OCR: share 1.1, least 8.
    """
    kinds = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in by)

    def fold(rows: list[dict]) -> Iterator[tuple]:
        tolerance = max(least, share * statistics.median(max(1.0, r["h"]) for r in rows))
        lines: list[list] = []
        for r in rows:
            middle = r["y"] + r["h"] / 2
            for line in lines:
                if abs(line[0] / line[1] - middle) <= tolerance:
                    break
            else:
                lines.append(line := [0.0, 0, 0.0, []])
            line[0], line[1], line[2] = line[0] + middle, line[1] + 1, line[2] + r["y"]
            line[3].append((r["x"], r["y"], r["idx"], r["text"]))
        lines.sort(key=lambda line: line[2] / line[1])
        yield ("\n".join(" ".join(w[3] for w in sorted(line[3], key=lambda w: w[:3])) for line in lines),)

    return per_page(words.select(*by, "idx", "text", "x", "y", "h"), fold, f"{kinds}, text string", by, ["y", "x", "idx"])


def true_median(values: Column) -> Column:
    """The median with the mean of the two middle values; 1 of nothing."""
    return F.coalesce(F.median(values), F.lit(1.0))


BLANK = r"(?U)^[\s\p{Cntrl}]*$"


def page_words(glyphs: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """chars_to_words where that gives a page three words or more, all short; else words by geometry."""
    plain = chars_to_words(glyphs, by)
    fine = plain.groupBy(*by).agg(((F.count("*") >= 3) & (F.max(F.length("text")) < 120)).alias("_fine")).where("_fine").select(*by)
    return plain.join(fine, by, "left_semi").unionByName(spatial_words(glyphs.join(fine, by, "left_anti"), by))


def spatial_words(glyphs: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Words of a page's characters by where they stand: lines are clusters of the middles, a word ends at a gap of over 1.35 widths.

    Boxes have their top at the smaller value, as pages rendered from the upper edge have. Fixed values: tolerances.
    """
    rows = glyphs.where(~F.col("char").rlike(BLANK)).withColumns({"_cy": (F.col("top") + F.col("bottom")) / 2, "_h": F.greatest(F.lit(1.0), (F.col("bottom") - F.col("top")).cast("double")), "_w": F.greatest(F.lit(1.0), (F.col("right") - F.col("left")).cast("double"))})
    groups = rows.groupBy(*by).agg(F.collect_list(F.col("_cy").cast("double")).alias("_ys"), F.greatest(F.lit(3.0), 0.65 * true_median(F.col("_h"))).alias("_t"))
    lines = groups.select(*by, F.posexplode(clusters(F.col("_ys"), F.col("_t"))).alias("_line", "c")).select(*by, "_line", F.array_min("c.members").alias("_low"), F.array_max("c.members").alias("_high"))
    rows = rows.join(lines, by).where((F.col("_cy") >= F.col("_low")) & (F.col("_cy") <= F.col("_high")))
    line = Window.partitionBy(*by, "_line")
    row = line.orderBy("left", "idx")
    wide = F.greatest(F.lit(4.1), 1.35 * F.median("_w").over(line))
    rows = rows.withColumns({"_limit": wide, "_gap": F.col("left") - F.lag("right").over(row)})
    rows = rows.withColumn("_word", F.sum(F.when(F.col("_gap") > F.col("_limit"), 1).otherwise(0)).over(row))
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "idx", "char"))), lambda s: s["char"]), "")
    words = rows.groupBy(*by, "_line", "_word").agg(spelled.alias("text"), F.min("left").alias("x"), F.min("top").alias("y"), (F.max("right") - F.min("left")).alias("w"), (F.max("bottom") - F.min("top")).alias("h"))
    return words.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy("_line", "_word")) - 1).drop("_line", "_word")


def chars_to_words(glyphs: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Words of a page's characters in content order: white space ends one; boxes are the characters' bounds."""
    w = Window.partitionBy(*by).orderBy("idx")
    blank = F.col("char").rlike(BLANK)
    rows = glyphs.withColumn("_word", F.sum(blank.cast("int")).over(w)).where(~blank)
    words = rows.groupBy(*by, "_word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "char"))), lambda s: s["char"]), "").alias("text"), F.min("left").alias("x"), F.min("top").alias("y"), (F.max("right") - F.min("left")).alias("w"), (F.max("bottom") - F.min("top")).alias("h"))
    return words.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy("_word")) - 1).drop("_word")
