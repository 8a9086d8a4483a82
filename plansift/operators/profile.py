"""Tables drawn under longitudinal profiles: the row of nodes, and the levels, depths and diameters in its columns.

Everything is a join of few points per page and an aggregate over bands of them; bands come from the running-mean clustering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions import rules, text
from plansift.operators.geometry import PAGE, centred, evidence, near_join
from plansift.operators.rows import clusters, gap_tolerance, upper_median
from plansift.sources.shared import stored

# Reaches, limits and score points.
STANDARD = r"(?iu)^(?:DN|D|Ø)?(800|1000|1200|1500|1800|2000|2500|3000)$"


def compact(token: Column) -> Column:
    return F.replace(text.extracted(token), F.lit(" "), F.lit(""))


def levels(words: DataFrame) -> DataFrame:
    """Words that are elevations: page, idx, x, y (centres), h, value."""
    w = centred(words).withColumn("value", rules.elevation(F.col("text"))).where("value IS NOT NULL")
    return w.select(*PAGE, "idx", F.col("cx").alias("x"), F.col("cy").alias("y"), F.greatest(F.lit(1.0), F.col("h")).alias("h"), "value")


def plain_numbers(words: DataFrame, pattern: str, low: float, high: float) -> DataFrame:
    w = centred(words).where(F.trim("text").rlike(pattern)).withColumn("value", F.replace(F.trim("text"), F.lit(","), F.lit(".")).try_cast("double"))
    return w.where(F.col("value").between(low, high)).select(*PAGE, "idx", F.col("cx").alias("x"), F.col("cy").alias("y"), F.greatest(F.lit(1.0), F.col("h")).alias("h"), "value")


def diameters(words: DataFrame) -> DataFrame:
    w = centred(words).withColumn("value", F.regexp_extract(compact(F.col("text")), r"(?iu)^(?:DN|D|Ø)?(\d{3,4})$", 1).try_cast("int"))
    return w.where(rules.plausible_manhole_diameter(F.col("value"))).select(*PAGE, "idx", F.col("cx").alias("x"), F.col("cy").alias("y"), F.greatest(F.lit(1.0), F.col("h")).alias("h"), F.col("value").cast("double").alias("value"))


def in_bands(points: DataFrame, tolerance: DataFrame | None = None, share: float = 0.9, low: float = 3.5, high: float = 15.0, least: int = 1, crowd: int = 1) -> DataFrame:
    """points plus band: clusters of y on a page, of `least` points or more, on pages of `crowd` points or more. The tolerance is a
    clamped share of the upper median height of these points, or a table of its own (page, tolerance)."""
    rest = [c for c in points.columns if c not in PAGE]
    groups = points.groupBy(*PAGE).agg(F.collect_list(F.when(F.col("y").isNotNull(), F.struct(*rest))).alias("_points"), rules.clamp(share * upper_median(F.collect_list("h")), low, high).alias("_own"), F.count("*").alias("_crowd"))
    groups = groups.where(F.col("_crowd") >= crowd)
    if tolerance is not None:
        groups = groups.join(tolerance, PAGE).withColumn("_own", F.col("tolerance"))
    ys = F.transform("_points", lambda p: p["y"].cast("double"))
    bands = groups.select(*PAGE, "_points", F.posexplode(clusters(ys, F.col("_own"))).alias("band", "c")).where(F.size("c.members") >= least)
    bands = bands.select(*PAGE, "band", "_points", F.array_min("c.members").alias("_low"), F.array_max("c.members").alias("_high"))
    inside = F.filter("_points", lambda p: (p["y"] >= F.col("_low")) & (p["y"] <= F.col("_high")))
    return bands.select(*PAGE, "band", F.explode(inside).alias("_p")).select(*PAGE, *[F.col(f"_p.{c}").alias(c) for c in rest], "band")


def in_columns(anchors: DataFrame, banded: DataFrame) -> DataFrame:
    """page, idx (anchor), x, band, value, dx: for each anchor and band the nearest point in x, if within the anchor's tolerance."""
    p = banded.select(*PAGE, "band", F.col("idx").alias("_p"), F.col("x").alias("_px"), "value")
    near = anchors.select(*PAGE, "idx", "x", "tolerance").join(p, PAGE).withColumn("dx", F.abs(F.col("_px") - F.col("x"))).where(F.col("dx") <= F.col("tolerance"))
    first = Window.partitionBy(*PAGE, "idx", "band").orderBy("dx", "_p")
    return near.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*PAGE, "idx", "x", "band", "value", "dx")


def family(anchors: DataFrame, words: DataFrame, page_text: DataFrame) -> DataFrame:
    """page, prefix: the letters that nodes of a page bear: KD or KS if a bare number beside an anchor confirms it, else D for storm
    and S for sanitary sewers, by the page's words (page, text). Pages without any sign are left out."""
    bare = centred(words).where(F.trim("text").rlike(r"^\d{1,2}$"))
    known = anchors.withColumns({"_f": F.regexp_extract("identifier", r"^(KD|KS)\d+$", 1), "_d": F.regexp_extract("identifier", r"^(?:KD|KS)(\d+)$", 1)}).where("_f <> ''")
    seen = near_join(known, bare, 75.0, 32.0, lx="x", ly="y").where(F.trim("r_text") == F.col("_d")).groupBy(*PAGE).agg(F.collect_set("_f").alias("_seen"))
    said = page_text.groupBy(*PAGE).agg(F.concat_ws("\n", F.collect_list("text")).alias("_t"))
    storm, sanitary = F.col("_t").rlike(r"(?iu)KANALIZACJI\s+DESZCZ|DESZCZOW"), F.col("_t").rlike(r"(?iu)KANALIZACJI\s+SANITAR|SANITARN")
    rows = said.join(seen, PAGE, "left")
    n = F.coalesce(F.size("_seen"), F.lit(0))
    prefix = F.when(n == 2, F.when(sanitary & ~storm, "KS").when(storm & ~sanitary, "KD")).when(n == 1, F.get("_seen", F.lit(0))).when(storm, "D").when(sanitary, "S")
    return rows.select(*PAGE, prefix.alias("prefix"), (n == 2).alias("both")).where("prefix IS NOT NULL")


def numeric_rows(words: DataFrame) -> DataFrame:
    """page, number, x, y, idx of the best row of bare numbers on each page.

    Score: 5 a number, 24 a neighbour one apart, 20 a column with two elevations, up to 20 for the row's width. A row counts if it is
    120 wide and has three numbers with enough links and two such columns, or five numbers and four links.
    """
    token = F.regexp_replace(F.trim("text"), r"^[^0-9]+|[^0-9]+$", "")
    bare = centred(words).withColumn("number", F.when(token.rlike(r"^\d{1,2}$"), token.cast("int"))).where(F.col("number").between(1, 99))
    bare = bare.select(*PAGE, "idx", "number", F.col("cx").alias("x"), F.col("cy").alias("y"), "h")
    enough = bare.groupBy(*PAGE).agg(F.count("*").alias("_n"), rules.clamp(0.65 * F.coalesce(upper_median(F.collect_list(F.when(F.col("h") > 0, F.col("h")))), F.lit(10.0)), 3.0, 8.0).alias("tolerance")).where("_n >= 3").drop("_n")
    rows = in_bands(bare, enough)
    first = Window.partitionBy(*PAGE, "band", "number").orderBy("x", "idx")
    rows = stored(rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "numbers")
    pairs = near_join(rows, levels(words), 75.0, 360.0, lx="x", ly="y", rx="x", ry="y").where(F.abs(F.col("y") - F.col("r_y")) >= 35)
    columns = pairs.groupBy(*PAGE, "idx").agg((F.count("*") >= 2).alias("_column"))
    step = F.abs(F.col("number") - F.lag("number").over(Window.partitionBy(*PAGE, "band").orderBy("x", "idx")))
    rows = rows.withColumn("_step", step).join(columns, [*PAGE, "idx"], "left")
    sums = rows.groupBy(*PAGE, "band").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("span"), F.count_if(F.col("_step") == 1).alias("links"), F.count_if("_column").alias("columns"))
    links = F.greatest(F.lit(2), F.floor(F.col("n") / 2))
    fine = (F.col("span") >= 120) & (((F.col("n") >= 3) & (F.col("links") >= links) & (F.col("columns") >= 2)) | ((F.col("n") >= 5) & (F.col("links") >= 4)))
    score = F.col("n") * 5 + F.col("links") * 24 + F.col("columns") * 20 + F.least(F.lit(20.0), F.col("span") / 80)
    best = sums.where(fine).withColumn("_r", F.row_number().over(Window.partitionBy(*PAGE).orderBy(score.desc(), "band"))).where("_r = 1").select(*PAGE, "band")
    return rows.join(best, [*PAGE, "band"]).select(*PAGE, "idx", "number", "x", "y")


def recovered(anchors: DataFrame, words: DataFrame, page_text: DataFrame) -> DataFrame:
    """anchors (page, idx, identifier, x, y) with nodes whose letters were lost: the best bare row under the page's family, unless three
    of the family are there; they replace anchors of the same name, and the other family goes where both were confirmed."""
    names = stored(family(anchors, words, page_text), "family")
    rows = anchors.join(names, PAGE, "left")
    other = F.when(F.col("prefix") == "KD", "KS").when(F.col("prefix") == "KS", "KD")
    rows = rows.where(~F.coalesce(F.col("both") & F.col("identifier").rlike(r"^(?:KD|KS)\d+$") & F.startswith("identifier", other), F.lit(False)))
    own = F.coalesce(F.startswith("identifier", F.col("prefix")) & F.substring("identifier", 1, 9).rlike(r"^[A-Z]+\d") & (F.regexp_extract("identifier", r"^([A-Z]+)", 1) == F.col("prefix")), F.lit(False))
    ready = rows.groupBy(*PAGE).agg((F.count_if(own) >= 3).alias("_ready"))
    fresh = numeric_rows(words).join(names, PAGE).join(ready, PAGE, "left").where(~F.coalesce("_ready", F.lit(False)))
    fresh = stored(fresh.select(*PAGE, "idx", F.concat("prefix", F.col("number").cast("string")).alias("identifier"), "x", "y"), "fresh")
    kept = rows.join(fresh.select(*PAGE, "identifier"), [*PAGE, "identifier"], "left_anti").select(*PAGE, "idx", "identifier", "x", "y")
    return kept.unionByName(fresh)


def node_rows(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """The anchors that stand for a profile's nodes, one per identifier.

    Bands of anchors score 240 for KDIST, 120 for three KD or KS, 24 a column with two elevations, 14 a column with a standard
    diameter, 2 an identifier, less 4 for an index and 5 for D or S from 30 on. Of the best band: KDIST and KD, or the largest of
    KD, KS and K if three; with fewer than three nodes, anchors with two elevations in their column (two at least), else all.
    """
    tol = words.groupBy(*PAGE).agg(rules.clamp(0.8 * F.coalesce(upper_median(F.collect_list(F.when(F.col("h") > 0, F.col("h")))), F.lit(10.0)), 6.0, 12.0).alias("tolerance"))
    rows = in_bands(anchors.withColumn("h", F.lit(1.0)), tol)
    lev = levels(words).select(*PAGE, F.col("x").alias("_lx"), F.col("y").alias("_ly"))
    column = anchors.join(lev, PAGE).where((F.abs(F.col("_lx") - F.col("x")) <= 70) & (F.abs(F.col("_ly") - F.col("y")) >= 35)).groupBy(*PAGE, "idx", "identifier").agg((F.count("*") >= 2).alias("_column"))
    dn = centred(words).where(compact(F.col("text")).rlike(STANDARD)).select(*PAGE, F.col("cx").alias("_dx"))
    has_dn = anchors.join(dn, PAGE).where(F.abs(F.col("_dx") - F.col("x")) <= 75).select(*PAGE, "idx", "identifier").distinct().withColumn("_dn", F.lit(True))
    column, has_dn = stored(column, "columns"), stored(has_dn, "columns-dn")
    rows = stored(rows.join(column, [*PAGE, "idx", "identifier"], "left").join(has_dn, [*PAGE, "idx", "identifier"], "left"), "node-bands")
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE, "band", "identifier").orderBy("idx"))).where("_n = 1")
    late = F.coalesce(F.regexp_extract("identifier", r"^(?:D|S)(\d+)$", 1).try_cast("int") >= 30, F.lit(False))
    penalty = F.when(F.col("identifier").rlike("[./-]"), 4).otherwise(0) + F.when(late, 5).otherwise(0)
    sums = one.groupBy(*PAGE, "band").agg(
        F.count_if("_column").alias("columns"),
        F.count_if("_dn").alias("dns"),
        F.count("*").alias("n"),
        F.sum(penalty).alias("penalty"),
        F.bool_or(F.col("identifier") == "KDIST").alias("marker"),
        (F.count_if(F.col("identifier").rlike(r"^(?:KD|KS)\d")) >= 3).alias("cohesive"),
    )
    spans = rows.groupBy(*PAGE, "band").agg((F.max("x") - F.min("x")).alias("width"), F.avg("y").alias("middle"))
    score = F.when(F.col("marker"), 240).otherwise(0) + F.when(F.col("cohesive"), 120).otherwise(0) + 24 * F.col("columns") + 14 * F.col("dns") + 2 * F.col("n") - F.col("penalty")
    order = Window.partitionBy(*PAGE).orderBy(score.desc(), F.desc("columns"), F.desc("dns"), F.desc("n"), F.desc("width"), "band")
    best = sums.join(spans, [*PAGE, "band"]).withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*PAGE, "band", "middle", "marker")
    near = Window.partitionBy(*PAGE, "identifier").orderBy(F.abs(F.col("y") - F.col("middle")), "idx")
    chosen = rows.join(best, [*PAGE, "band"]).withColumn("_n", F.row_number().over(near)).where("_n = 1")
    page = Window.partitionBy(*PAGE)
    counts = {p: F.count_if(F.col("identifier").rlike(rf"^{p}\d")).over(page) for p in ("KD", "KS", "K")}
    chosen = chosen.withColumns({f"_{p}": c for p, c in counts.items()})
    top = F.greatest("_KD", "_KS", "_K")
    name = F.when(F.col("_KD") == top, "KD").when(F.col("_KS") == top, "KS").otherwise("K")
    by_family = (top < 3) | F.col("identifier").rlike(r"^K[DS]?\d") & (F.regexp_extract("identifier", r"^([A-Z]+)", 1) == name)
    chosen = chosen.where(F.when(F.col("marker"), F.col("identifier").rlike(r"^(?:KDIST$|KD\d)")).otherwise(by_family))
    chosen = stored(chosen.withColumn("_kept", F.count("*").over(page)).where("_kept >= 3").select(*PAGE, "idx", "identifier", "x", "y"), "chosen")
    rest = anchors.join(chosen.select(*PAGE).distinct(), PAGE, "left_anti").join(column, [*PAGE, "idx", "identifier"], "left")
    rest = evidence(words, rest, 420.0)
    ranked = Window.partitionBy(*PAGE, "identifier").orderBy(F.desc(F.coalesce("_column", F.lit(False))), F.desc("score"), "idx")
    rest = rest.withColumn("_n", F.row_number().over(ranked)).where("_n = 1")
    rest = rest.withColumn("_supported", F.count_if("_column").over(page)).where((F.col("_supported") < 2) | F.coalesce("_column", F.lit(False)))
    return chosen.unionByName(rest.select(*PAGE, "idx", "identifier", "x", "y"))


def with_tolerance(anchors: DataFrame, share: float = 0.36, low: float = 15.0, high: float = 65.0, least: float = 2.0) -> DataFrame:
    """anchors plus tolerance, a clamped share of the upper median gap between them (for a single gap-less page its width over n)."""
    span = anchors.groupBy(*PAGE).agg(F.greatest(F.lit(50.0), (F.max("x") - F.min("x")) / F.greatest(F.lit(3), F.count("*"))).alias("_wide"))
    gaps = gap_tolerance(anchors, "x", share, low, high, fallback=-1.0, least=least).join(span, PAGE)
    tolerance = F.when(F.col("gap") < 0, rules.clamp(share * F.col("_wide"), low, high)).otherwise(F.col("tolerance"))
    return anchors.join(gaps.select(*PAGE, tolerance.alias("tolerance")), PAGE)


def column_levels(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """page, idx, ground_m, invert_m: the pair of rows of levels that most columns meet .35 to 8 m apart, the best aligned at a tie.

    Pages of two anchors and four levels at least; a column reaches .34 of the gap between anchors. Which of a column's two levels is
    ground is told by their values alone.
    """
    some = anchors.join(anchors.groupBy(*PAGE).agg(F.count("*").alias("_anchors")).where("_anchors >= 2"), PAGE)
    lev = plain_numbers(words, r"^\d{2,3}[,.]\d{2}$", 20, 250)
    rows = in_bands(lev, low=4.1, high=14.1, crowd=4)
    least = some.groupBy(*PAGE).agg(F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.count("*") / 4))).alias("_least"))
    full = rows.groupBy(*PAGE, "band").agg(F.count("*").alias("_size")).join(least, PAGE).where(F.col("_size") >= F.col("_least")).select(*PAGE, "band")
    tolerance = gap_tolerance(some, "x").select(*PAGE, "tolerance")
    at = stored(in_columns(some.join(tolerance, PAGE), rows.join(full, [*PAGE, "band"])), "column-points")
    other = at.select(*PAGE, "idx", F.col("band").alias("_band"), F.col("value").alias("_value"), F.col("dx").alias("_dx"))
    pairs = stored(at.join(other, [*PAGE, "idx"]).where((F.col("band") < F.col("_band")) & F.abs(F.col("value") - F.col("_value")).between(0.35, 8.0)), "column-pairs")
    sums = pairs.groupBy(*PAGE, "band", "_band").agg(F.count("*").alias("hits"), F.sum(F.col("dx") + F.col("_dx")).alias("off")).where("hits >= 2")
    best = sums.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("hits"), "off", "band", "_band"))).where("_n = 1").select(*PAGE, "band", "_band")
    return pairs.join(best, [*PAGE, "band", "_band"]).select(*PAGE, "idx", F.greatest("value", "_value").alias("ground_m"), F.least("value", "_value").alias("invert_m"))


def column_diameters(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """page, idx, diameter_mm: the row of diameters that most columns meet, if enough do: a third of them, three at least, six at most."""
    some = anchors.join(anchors.groupBy(*PAGE).agg(F.count("*").alias("_anchors")).where("_anchors >= 2"), PAGE)
    rows = in_bands(diameters(words), share=1.0, low=5.0, high=16.0, crowd=2)
    sizes = rows.groupBy(*PAGE, "band").agg(F.count("*").alias("_size"))
    at = stored(in_columns(some.join(gap_tolerance(some, "x").select(*PAGE, "tolerance"), PAGE), rows), "column-sizes")
    n = some.groupBy(*PAGE).agg(F.count("*").alias("_n"))
    hits = at.groupBy(*PAGE, "band").agg(F.count("*").alias("hits")).join(sizes, [*PAGE, "band"]).join(n, PAGE)
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("hits"), F.desc("_size"), "band"))).where(F.col("_r") == 1)
    best = best.where(F.col("hits") >= enough(F.col("_n"), 3, 6)).select(*PAGE, "band")
    return at.join(best, [*PAGE, "band"]).select(*PAGE, "idx", F.rint("value").cast("int").alias("diameter_mm"))


def enough(n: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(n / 3)))


def elevations(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """page, idx, ground_m, invert_m, depth_m, evidence from the page's best rows: three rows with ground - invert = depth (evidence 4);
    on pages without such, the two rows that cover most columns smoothly (evidence 3). anchors with tolerance."""
    lev = plain_numbers(words, r"^\d{2,3}[,.]\d{2}$", 20, 250)
    tol = lev.groupBy(*PAGE).agg(rules.clamp(0.9 * upper_median(F.collect_list("h")), 3.5, 15.0).alias("tolerance"), F.count("*").alias("_four")).where("_four >= 4").drop("_four")
    at = stored(in_columns(anchors, in_bands(lev, share=0.9, low=3.5, high=15.0, least=2, crowd=4)), "level-points")
    deep = stored(in_columns(anchors, in_bands(plain_numbers(words, r"^\d{1,2}[,.]\d{2}$", 0.45, 8.0), tol, least=2)), "depth-points")
    n = anchors.groupBy(*PAGE).agg(F.count("*").alias("_anchors"))
    take = lambda df, p: df.select(*PAGE, "idx", F.col("band").alias(f"{p}_band"), F.col("value").alias(p), F.col("dx").alias(f"{p}_dx"))
    pairs = stored(at.select(*PAGE, "idx", "x").distinct().join(take(at, "g"), [*PAGE, "idx"]).join(take(at, "i"), [*PAGE, "idx"]).where("g_band <> i_band"), "level-pairs")
    rows = pairs.join(take(deep, "d"), [*PAGE, "idx"]).withColumn("_res", F.abs(F.col("g") - F.col("i") - F.col("d")))
    rows = stored(rows.where((F.col("g") - F.col("i")).between(0.45, 8.0) & (F.col("_res") <= 0.28)), "level-triples")
    bands = ["g_band", "i_band", "d_band"]
    scored = rows.groupBy(*PAGE, *bands).agg(F.count("*").alias("hits"), F.avg("_res").alias("_r"), F.avg(F.col("g_dx") + F.col("i_dx") + F.col("d_dx")).alias("_dx")).join(n, PAGE).where(F.col("hits") >= enough(F.col("_anchors"), 2, 4))
    score = 70 * F.col("hits") - 180 * F.col("_r") - 0.5 * F.col("_dx")
    top = lambda df, s, cols: df.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy(s.desc(), *cols))).where("_n = 1").select(*PAGE, *cols)
    best3 = stored(top(scored, score, bands), "best-triples")
    found3 = rows.join(best3, [*PAGE, *bands]).select(*PAGE, "idx", F.col("g").alias("ground_m"), F.col("i").alias("invert_m"), F.col("d").alias("depth_m"), F.lit(4).alias("evidence"))
    two = pairs.where((F.col("g") - F.col("i")).between(0.45, 6.5)).join(best3.select(*PAGE), PAGE, "left_anti")
    row = Window.partitionBy(*PAGE, "g_band", "i_band").orderBy("x", "idx")
    two = two.withColumns({"_gr": F.abs(F.col("g") - F.lag("g").over(row)), "_ir": F.abs(F.col("i") - F.lag("i").over(row))})
    scored = two.groupBy(*PAGE, "g_band", "i_band").agg(F.count("*").alias("hits"), F.avg(F.col("g_dx") + F.col("i_dx")).alias("_dx"), F.coalesce(F.sum("_gr"), F.lit(0.0)).alias("_gr"), F.coalesce(F.sum("_ir"), F.lit(0.0)).alias("_ir")).join(n, PAGE).where(F.col("hits") >= enough(F.col("_anchors"), 2, 4))
    best2 = top(scored, 35 * F.col("hits") - 0.8 * F.col("_dx") - 3.2 * F.col("_gr") - 2 * F.col("_ir"), ["g_band", "i_band"])
    found2 = two.join(best2, [*PAGE, "g_band", "i_band"]).select(*PAGE, "idx", F.col("g").alias("ground_m"), F.col("i").alias("invert_m"), F.lit(None).cast("double").alias("depth_m"), F.lit(3).alias("evidence"))
    return found3.unionByName(found2)


def node_diameters(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """page, idx, diameter_mm: from the row of diameters with most hits and the most frequent value; where it has none, the most
    frequent standard diameter (or metres) written in the node's column, at a tie the closest to 1200."""
    at = stored(in_columns(anchors, in_bands(diameters(words), share=1.1, low=4.1, high=18.0)), "size-points")
    n = anchors.groupBy(*PAGE).agg(F.count("*").alias("_anchors"))
    values = at.groupBy(*PAGE, "band", F.rint("value").alias("_v")).agg(F.count("*").alias("_c"))
    scored = values.groupBy(*PAGE, "band").agg(F.sum("_c").alias("hits"), F.max("_c").alias("_top")).join(n, PAGE).where(F.col("hits") >= enough(F.col("_anchors"), 2, 4))
    order = Window.partitionBy(*PAGE).orderBy((20 * F.col("hits") + 40 * F.col("_top") / F.col("hits")).desc(), "band")
    best = scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*PAGE, "band")
    found = at.join(best, [*PAGE, "band"]).select(*PAGE, "idx", F.rint("value").cast("int").alias("diameter_mm"))
    t = compact(F.col("text"))
    metres = F.replace(F.regexp_extract(t, r"(?i)^([0123][,.]\d{1,2})m?$", 1), F.lit(","), F.lit(".")).try_cast("double")
    mm = F.coalesce(F.regexp_extract(t, STANDARD, 1).try_cast("int"), rules.snapped(metres * 1000, 50).cast("int"))
    near = centred(words).withColumn("_mm", mm).where(rules.plausible_manhole_diameter(F.col("_mm"))).select(*PAGE, "_mm", "cx")
    free = anchors.join(n.where("_anchors >= 2").select(*PAGE), PAGE, "left_semi").join(found.select(*PAGE, "idx"), [*PAGE, "idx"], "left_anti")
    votes = free.join(near, PAGE).where(F.abs(F.col("cx") - F.col("x")) <= F.greatest(F.lit(28.0), F.col("tolerance"))).groupBy(*PAGE, "idx", "_mm").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*PAGE, "idx").orderBy(F.desc("_c"), F.abs(F.col("_mm") - 1200), "_mm")
    rescued = votes.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*PAGE, "idx", F.col("_mm").alias("diameter_mm"))
    return found.unionByName(rescued)


def profile_nodes(anchors: DataFrame, words: DataFrame, page_text: DataFrame) -> DataFrame:
    """page, identifier, x, y, ground_m, invert_m, height_m, diameter_mm, evidence of a profile's nodes.

    A depth hides the levels it came with and gives the height alone; without it the height is ground less invert.
    """
    words = stored(words, "words")  # each step below reads its input several times over
    found = stored(recovered(stored(anchors, "anchors"), words, page_text), "recovered")
    nodes = stored(with_tolerance(stored(node_rows(found, words), "rows")), "nodes")
    out = nodes.join(elevations(nodes, words), [*PAGE, "idx"], "left").join(node_diameters(nodes, words), [*PAGE, "idx"], "left")
    from_depth = F.when(F.col("evidence") >= 4, rules.height_of_depth(F.col("depth_m")))
    height = F.coalesce(from_depth, rules.cents(F.col("ground_m") - F.col("invert_m")))
    shown = lambda c: F.when(from_depth.isNull(), F.col(c)).alias(c)
    return out.select(*PAGE, "idx", "identifier", "x", "y", shown("ground_m"), shown("invert_m"), height.alias("height_m"), "diameter_mm", F.coalesce("evidence", F.lit(0)).alias("evidence"))
