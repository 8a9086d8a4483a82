"""Spatial joins over word boxes.

A theta join on coordinates alone would be a nested loop; each join here first meets on a page and a grid cell as wide as its reach,
one side copied to the neighbouring cells, and tests distances on what meets. Pages bound the groups; a crowded page is split by its
cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions import rules, text

PAGE = ["doc_id", "page_no"]


def centred(words: DataFrame) -> DataFrame:
    """words plus cx and cy, the centres of the boxes."""
    return words.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") - F.col("h") / 2})


def usable(words: DataFrame) -> DataFrame:
    some = F.greatest(F.abs("x"), F.abs("y"), F.abs("w"), F.abs("h")) > 0.001
    return words.where(rules.filled(F.col("text")) & some)


def near_join(left: DataFrame, right: DataFrame, reach_x: float, reach_y: float, on: list[str] = PAGE, lx="cx", ly="cy", rx="cx", ry="cy") -> DataFrame:
    """Pairs on one page at most reach apart in x and in y. Columns of left as they are, of right with r_ before them (on apart)."""
    cell = lambda c, size: F.floor(F.col(c) / size)
    a = left.withColumns({"_gx": cell(lx, reach_x), "_gy": cell(ly, reach_y)})
    b = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on])
    around = lambda c, size: F.explode(F.sequence(cell(c, size) - 1, cell(c, size) + 1))
    b = b.withColumn("_gx", around(f"r_{rx}", reach_x)).withColumn("_gy", around(f"r_{ry}", reach_y))
    pairs = a.join(b, [*on, "_gx", "_gy"])
    return pairs.where((F.abs(F.col(lx) - F.col(f"r_{rx}")) <= reach_x) & (F.abs(F.col(ly) - F.col(f"r_{ry}")) <= reach_y)).drop("_gx", "_gy")


def nearest(pairs: DataFrame, by: list[str], cost: Column, ties: list[str], k: int = 1) -> DataFrame:
    """The k cheapest pairs of each group, ties by the given columns."""
    w = Window.partitionBy(*by).orderBy("_cost", *ties)
    return pairs.withColumn("_cost", cost).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def as_column(value: Column | str | bool | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def split_labels(words: DataFrame, kind: Column | str = "") -> DataFrame:
    """Identifiers written as two words, letters and number: the cheapest number right of each prefix.

    kind: the page's drawing type, a column or one for all; a plan (PZT) has wider reaches, the K family is on profiles alone. idx is
    the prefix's, source_idx the smaller of the two. Fixed values: reaches and weights of the cost.
    """
    w = centred(words.withColumns({"_t": text.spatial_token(F.col("text")), "_kind": as_column(kind)}))
    plan = F.col("_kind") == "PZT"
    prefixes = w.where(F.col("_t").rlike("(?i)^(?:KD|KS|D|S)$") | ((F.col("_kind") == "PROFIL") & F.col("_t").rlike("(?i)^K$")))
    numbers = w.where(F.col("_t").rlike(r"^\d{1,3}(?:[./-]\d+)*$")).select(*PAGE, "idx", "_t", "x", "h", "cx", "cy")
    pairs = near_join(prefixes, numbers, 490.0, 400.0)
    dy, dx, di = F.abs(F.col("cy") - F.col("r_cy")), F.abs(F.col("cx") - F.col("r_cx")), F.abs(F.col("idx") - F.col("r_idx"))
    pick = lambda on_plan, elsewhere: F.when(plan, F.lit(on_plan)).otherwise(F.lit(elsewhere))
    beside = (F.col("r_x") >= F.col("x") - 12) & (F.col("r_x") - (F.col("x") + F.greatest(F.lit(0.0), F.col("w"))) <= pick(90.0, 52.0))
    level = dy <= F.greatest(pick(30.0, 22.0), pick(3.0, 2.4) * F.greatest("h", "r_h"))
    best = nearest(pairs.where(beside & level & ((di <= pick(240, 120)) | (dy <= 8))), [*PAGE, "idx"], 6 * dy + dx + F.least(F.lit(40), di), ["r_idx"])
    name = F.concat(F.upper("_t"), text.identifier_number(F.col("r__t")))
    found = best.select(*PAGE, "idx", name.alias("identifier"), ((F.col("cx") + F.col("r_cx")) / 2).alias("x"), ((F.col("cy") + F.col("r_cy")) / 2).alias("y"), F.least("idx", "r_idx").alias("source_idx"))
    return found.where(rules.likely_identifier(F.col("identifier")))


def repaired_tokens(words: DataFrame, on: Column) -> DataFrame:
    """words plus _t, the token; where `on` holds (profiles read by OCR), last digits misread as letters are put right.

    Some tokens are put right only where another reading at the same place bears it out. Fixed values: tokens and reaches.
    """
    w = centred(words).withColumns({"_t": F.upper(text.spatial_token(F.col("text"))), "_on": on})
    asking = w.where(F.col("_on") & F.col("_t").isin("KS21", "S31"))
    others = w.where(F.col("_t").rlike(r"^(?:KSE\.1|KSEI|KS3)$")).select(*PAGE, "idx", "_t", "x", "cy")
    dx = F.abs(F.col("x") - F.col("r_x"))
    bears = ((F.col("_t") == "KS21") & (F.col("r__t") != "KS3") & (dx <= 24)) | ((F.col("_t") == "S31") & (F.col("r__t") == "KS3") & (dx <= 45))
    near = near_join(asking, others, 45.0, 400.0, lx="x", rx="x").where(bears & (F.abs(F.col("cy") - F.col("r_cy")) <= F.greatest(F.lit(4.0), F.col("h"))))
    w = w.join(near.select(*PAGE, "idx").distinct().withColumn("_borne_out", F.lit(True)), [*PAGE, "idx"], "left")
    t = F.col("_t")
    right = F.when(t.rlike(r"^KD[IL|]$"), "KD1").when(t == "KDS", "KD5").when(t.isin("KSE.1", "KSEI") | (F.col("_borne_out") & (t == "KS21")), "KS2.1").when(F.col("_borne_out") & (t == "S31"), "KS3.1").otherwise(t)
    return w.withColumn("_t", F.when(F.col("_on"), right).otherwise(t)).drop("_on", "_borne_out")


def exact_labels(words: DataFrame, profile: Column | bool, ocr: Column | None = None) -> DataFrame:
    """Identifiers that are one whole word; the K family on profiles alone. With ocr (whether OCR read the page), see repaired_tokens."""
    profile = as_column(profile)
    w = centred(words.withColumn("_t", F.upper(text.spatial_token(F.col("text"))))) if ocr is None else repaired_tokens(words, profile & ocr)
    rows = w.where(F.col("_t").rlike(r"^(?:(?:KD|KS)\d+(?:[./-]\d+)*|[DSK]\d{1,3}(?:[./-]\d+)*|KDIST|SO)$") & (profile | ~F.col("_t").rlike(r"^K\d")))
    found = rows.select(*PAGE, "idx", text.parsed_identifier(F.col("_t")).alias("identifier"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("idx").alias("source_idx"))
    return found.where(rules.likely_identifier(F.col("identifier")))


def word_inlets(words: DataFrame) -> DataFrame:
    t = text.spatial_token(F.col("text"))
    rows = words.where(t.rlike(r"(?i)^WP\d{1,3}(?:[./-]\d+)*$") | t.rlike("^W[0-8]$"))
    number = text.identifier_number(F.regexp_extract(t, r"^(?i:WP|W)(.*)$", 1))
    return rows.select(*PAGE, "idx", F.concat(F.lit("WP"), number).alias("identifier"), "text").groupBy(*PAGE, "identifier").agg(F.min("idx").alias("idx"), F.min_by("text", "idx").alias("raw_text")).withColumn("confidence", F.lit("wysoka"))


def neighbour_midpoints(anchors: DataFrame, page_width: Column | None = None) -> DataFrame:
    """anchors plus left and right: the middles to the neighbours in x, or an edge half-width beyond the outer ones.

    page_width: a column; without it, the anchors' extent. Fixed values: the half-widths 45 (4 % of the page's width) and, for a
    single anchor, 140 (65 %).
    """
    page = Window.partitionBy(*PAGE)
    w = page.orderBy("x", "idx")
    width = F.max("x").over(page) - F.min("x").over(page) if page_width is None else page_width
    alone = F.count("*").over(page) == 1
    edge = F.when(alone, F.greatest(F.lit(140.0), 0.65 * width)).otherwise(F.greatest(F.lit(45.0), 0.04 * width))
    return anchors.select("*", F.coalesce((F.lag("x").over(w) + F.col("x")) / 2, F.col("x") - edge).alias("left"), F.coalesce((F.lead("x").over(w) + F.col("x")) / 2, F.col("x") + edge).alias("right"))


def owned_words(words: DataFrame, anchors: DataFrame, slack: float = 1.18, close: float = 48.0, reach_x: Column | float = 360.0, reach_y: Column | float = 260.0) -> DataFrame:
    """Words in an anchor's box that no other anchor is nearer to by more than the slack, or that are very close; by distance.

    Every anchor that could be nearer than one whose box holds the word is within the boxes' diagonal. Box sizes may be columns of
    anchors (of at most 360 and 260).
    """
    far = 444.0 if isinstance(reach_x, Column) or isinstance(reach_y, Column) else (reach_x**2 + reach_y**2) ** 0.5
    boxed = anchors.withColumns({"_bx": as_column(reach_x), "_by": as_column(reach_y)})
    pairs = near_join(centred(words), boxed, far, far, rx="x", ry="y")
    pairs = pairs.withColumn("distance", F.hypot(F.col("cx") - F.col("r_x"), F.col("cy") - F.col("r_y")))
    word = Window.partitionBy(*PAGE, "idx").orderBy("distance", "r_idx")
    # the nearest other anchor: the first of all but for the first itself, for which it is the second
    pairs = pairs.withColumn("_other", F.when(F.row_number().over(word) == 1, F.lead("distance").over(word)).otherwise(F.first("distance").over(word)))
    inside = (F.abs(F.col("cx") - F.col("r_x")) <= F.col("r__bx")) & (F.abs(F.col("cy") - F.col("r_y")) <= F.col("r__by"))
    keep = F.col("_other").isNull() | (F.col("distance") <= slack * F.col("_other")) | (F.col("distance") <= close)
    return pairs.where(inside & keep).select(*PAGE, F.col("r_idx").alias("anchor_idx"), "idx", "text", "distance")


def column_words(words: DataFrame, anchors: DataFrame, reach_y: Column | float, cell: float = 256.0) -> DataFrame:
    """Words between left and right of an anchor (see neighbour_midpoints) and at most reach_y from it in y; by distance."""
    at = lambda c: F.floor(F.col(c) / cell)
    a = anchors.select(*PAGE, F.col("idx").alias("anchor_idx"), F.col("x").alias("_ax"), F.col("y").alias("_ay"), "left", "right", as_column(reach_y).alias("_by"))
    a = a.withColumn("_gx", F.explode(F.sequence(at("left"), at("right"))))
    pairs = centred(words).withColumn("_gx", at("cx")).join(a, [*PAGE, "_gx"])
    pairs = pairs.where((F.col("cx") >= F.col("left")) & (F.col("cx") <= F.col("right")) & (F.abs(F.col("cy") - F.col("_ay")) <= F.col("_by")))
    return pairs.select(*PAGE, "anchor_idx", "idx", "text", F.hypot(F.col("cx") - F.col("_ax"), F.col("cy") - F.col("_ay")).alias("distance"))


def evidence(words: DataFrame, anchors: DataFrame, radius: Column | float = 300.0, most: float = 420.0) -> DataFrame:
    """anchors plus score: points for elevations, diameters, terms, materials and crowns within the radius (fixed values).

    radius: one for all, or a column of anchors of at most `most`.
    """
    reach = most if isinstance(radius, Column) else radius
    pairs = near_join(anchors.withColumn("_radius", as_column(radius)), centred(words), reach, reach, lx="x", ly="y")
    pairs = pairs.where(F.hypot(F.col("x") - F.col("r_cx"), F.col("y") - F.col("r_cy")) <= F.col("_radius"))
    level = rules.elevation(F.col("r_text"))
    one = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    sums = pairs.groupBy(*PAGE, "idx").agg(
        F.sort_array(F.collect_set(level)).alias("levels"),
        F.count(level).alias("n"),
        one(F.replace(text.extracted(F.col("r_text")), F.lit(" "), F.lit("")).rlike(r"(?iu)^(?:DN|Ø)?(?:800|1000|1200|1500|1800|2000|2500|3000)$")).alias("dn"),
        one(F.col("r_text").rlike("(?iu)studnia|studzienka|kinet|osadnik|rewizyj|rozpr[eę]ż")).alias("term"),
        one(F.col("r_text").rlike(r"(?iu)PVC|PYC|PP|PE|HDPE|PE-HD|DN\s*\d|Ø\s*\d")).alias("material"),
        one(F.col("r_text").rlike("(?iu)właz|pokrywa|zwieńczenie|D400|C250")).alias("crown"),
    )
    pair = F.exists("levels", lambda a: F.exists("levels", lambda b: (b - a).between(0.2, 15)))
    p = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    score = F.when((F.col("n") >= 2) & pair, 4).when(F.col("n") == 1, 1).otherwise(0) + p(F.col("dn"), 3) + p(F.col("term"), 3) + p(F.col("material"), 2) + p(F.col("crown"), 1)
    return anchors.join(sums.select(*PAGE, "idx", score.alias("score")), [*PAGE, "idx"], "left").withColumn("score", F.coalesce("score", F.lit(0)))


def best_anchors(words: DataFrame, anchors: DataFrame, kind: Column | str = "", ocr: Column | bool = False) -> DataFrame:
    """The anchor of most evidence for each identifier of a page, the first at a tie; on plans read by OCR, only credible ones."""
    scored = evidence(words, anchors)
    first = Window.partitionBy(*PAGE, "identifier").orderBy(F.desc("score"), "idx")
    scored = scored.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return scored.where(~((as_column(kind) == "PZT") & as_column(ocr)) | rules.credible_anchor(F.col("identifier"), F.col("score")))


def pair_of_nearest(near: DataFrame, profile: Column | bool = False) -> DataFrame:
    """ground_m and invert_m by page and idx: of the four nearest levels, the pair .20 to 15 m apart of least distance and misalignment.

    near: page, idx (the anchor's), value, distance, dx, dy, at (the level's place).
    """
    w = Window.partitionBy(*PAGE, "idx").orderBy("distance", F.abs(F.col("dx")), "at")
    four = near.withColumn("_n", F.row_number().over(w)).where("_n <= 4").withColumn("_profile", as_column(profile))
    four = four.groupBy(*PAGE, "idx").agg(F.sort_array(F.collect_list(F.struct("_n", "value", "distance", "dx", "dy"))).alias("l"), F.bool_or("_profile").alias("_profile"))
    apart = lambda a, b, c: F.abs(a[c] - b[c])
    pairs = []
    for i in range(4):
        for j in range(i + 1, 4):
            a, b = F.get("l", F.lit(i)), F.get("l", F.lit(j))
            off = F.when(F.col("_profile"), 3 * apart(a, b, "dx")).otherwise(2 * F.least(apart(a, b, "dx"), apart(a, b, "dy")))
            pairs.append(F.when(apart(a, b, "value").between(0.2, 15), F.struct((a["distance"] + b["distance"] + off).alias("cost"), F.lit(4 * i + j).alias("place"), F.greatest(a["value"], b["value"]).alias("g"), F.least(a["value"], b["value"]).alias("i"))))
    best = four.withColumn("b", F.array_min(F.filter(F.array(*pairs), lambda x: x.isNotNull()))).where("b IS NOT NULL")
    return best.select(*PAGE, "idx", F.col("b.g").alias("ground_m"), F.col("b.i").alias("invert_m"))


def local_pairs(anchors: DataFrame, levels: DataFrame, reach_x: float = 42.0, reach_y: float = 55.0, profile: bool = False) -> DataFrame:
    """ground_m and invert_m of each anchor by pair_of_nearest, from levels (idx, x, y, value) of the page within reach."""
    pairs = near_join(anchors, levels, reach_x, reach_y, lx="x", ly="y", rx="x", ry="y")
    dx, dy = F.col("r_x") - F.col("x"), F.col("r_y") - F.col("y")
    near = pairs.select(*PAGE, "idx", F.col("r_value").alias("value"), F.hypot(dx, dy).alias("distance"), dx.alias("dx"), dy.alias("dy"), F.col("r_idx").alias("at"))
    return pair_of_nearest(near, profile)


def local_materials(words: DataFrame, reach: float = 115.0) -> DataFrame:
    """material, diameter_mm and quantity by page: each material word with the nearest number; quantity counts places."""
    w = centred(words).withColumn("_t", text.spatial_token(F.col("text")))
    glued = w.withColumn("m", F.regexp_extract("_t", r"(?iu)^(PE-HD|PEHD|HDPE|PVC|PP|PE)(?:DN|Ø)?(\d{2,4})$", 1)).withColumn("d", F.regexp_extract("_t", r"(\d{2,4})$", 1).try_cast("int")).where("m <> ''")
    names = w.where(F.col("_t").rlike(r"(?iu)^(?:PE-HD|PEHD|HDPE|PVC|PP|PE)$"))
    numbers = w.withColumn("d", F.regexp_extract("_t", r"(?iu)^(?:DN|Ø)?(\d{2,4})$", 1).try_cast("int")).where(F.col("d").between(40, 2000))
    pairs = near_join(names, numbers, reach, 400.0)
    dx, dy = F.abs(F.col("cx") - F.col("r_cx")), F.abs(F.col("cy") - F.col("r_cy"))
    best = nearest(pairs.where(dy <= F.greatest(F.lit(28.0), 2.2 * F.col("h"))), [*PAGE, "idx"], dx + 3 * dy, ["r_idx"])
    rows = glued.where(F.col("d").between(40, 2000)).select(*PAGE, "m", "d", "cx", "cy").unionByName(best.select(*PAGE, F.col("_t").alias("m"), F.col("r_d").alias("d"), "cx", "cy"))
    return rows.groupBy(*PAGE, text.material(F.col("m")).alias("material"), F.col("d").alias("diameter_mm")).agg(F.count_distinct(F.rint("cx"), F.rint("cy")).alias("quantity"))


def stitched_words(words: DataFrame, gap: float = 4.1, parts: int = 5, span: float = 55.0) -> DataFrame:
    """Words (page, text, x, y, w, h) that read as elevations when up to five neighbours on a line, close together, are one.

    A line is what lies at most 2.5 to 6 (.45 of the height) from a word's middle and begins at most `span` right of it; runs begin
    anywhere on it, and a word alone is a run too. Once per text and rounded place. Fixed values: tolerances.
    """
    t = text.halved(F.trim("text"))
    some = words.where(t.rlike(r"^[0-9,.\]|Il]+$")).select(*PAGE, "idx", t.alias("t"), F.col("x").alias("left"), (F.col("x") + F.greatest(F.lit(0.0), F.col("w"))).alias("right"), (F.col("y") - F.col("h") / 2).alias("cy"), (F.col("y") - F.col("h")).alias("top"), F.col("y").alias("bottom"), "h")
    pairs = near_join(some.select(*PAGE, "idx", "left", "cy", "h"), some.drop("h"), span, 6.0, lx="left", ly="cy", rx="left", ry="cy")
    tolerance = F.greatest(F.lit(2.5), F.least(F.lit(6.0), 0.45 * F.col("h")))
    pairs = pairs.where((F.abs(F.col("cy") - F.col("r_cy")) <= tolerance) & (F.col("r_left") >= F.col("left") - 0.1))
    lines = pairs.groupBy(*PAGE, "idx").agg(F.sort_array(F.collect_list(F.struct(F.col("r_left").alias("left"), F.col("r_idx").alias("i"), F.col("r_right").alias("right"), F.col("r_t").alias("t"), F.col("r_top").alias("top"), F.col("r_bottom").alias("bottom")))).alias("l"))

    def runs(start: Column) -> Column:
        """The runs that begin at a place: each part joins while the gap to the rightmost edge so far is small enough."""
        first = F.struct(F.lit(True).alias("open"), F.lit("").alias("t"), F.lit(None).cast("double").alias("left"), F.lit(-1e300).alias("right"), F.lit(1e300).alias("top"), F.lit(-1e300).alias("bottom"))
        empty = F.array().cast("array<struct<open:boolean,t:string,left:double,right:double,top:double,bottom:double>>")
        acc0 = F.struct(first.alias("now"), empty.alias("out"))

        def step(acc: Column, p: Column) -> Column:
            now = acc["now"]
            fits = now["open"] & ((now["t"] == "") | (p["left"] - now["right"] <= gap))
            grown = F.struct(fits.alias("open"), F.concat(now["t"], p["t"]).alias("t"), F.coalesce(now["left"], p["left"]).alias("left"), F.greatest(now["right"], p["right"]).alias("right"), F.least(now["top"], p["top"]).alias("top"), F.greatest(now["bottom"], p["bottom"]).alias("bottom"))
            shut = F.struct(F.lit(False).alias("open"), *[now[c].alias(c) for c in ("t", "left", "right", "top", "bottom")])
            return F.when(fits, F.struct(grown.alias("now"), F.concat(acc["out"], F.array(grown)).alias("out"))).otherwise(F.struct(shut.alias("now"), acc["out"].alias("out")))

        return F.aggregate(F.slice("l", start, F.lit(parts)), acc0, step, lambda acc: acc["out"])

    found = lines.select(*PAGE, F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("l")), runs))).alias("r"))
    found = found.where(rules.elevation(F.col("r.t")).isNotNull())
    found = found.select(*PAGE, F.col("r.t").alias("text"), F.col("r.left").alias("x"), F.col("r.bottom").alias("y"), F.greatest(F.lit(1.0), F.col("r.right") - F.col("r.left")).alias("w"), F.greatest(F.lit(1.0), F.col("r.bottom") - F.col("r.top")).alias("h"))
    by = [*PAGE, "text", F.rint(F.col("x") * 10).alias("_x"), F.rint(F.col("y") * 10).alias("_y")]
    return found.groupBy(*by).agg(F.min(F.struct("x", "y", "w", "h")).alias("b")).select(*PAGE, "text", "b.x", "b.y", "b.w", "b.h")


def with_stitched(words: DataFrame) -> DataFrame:
    """words, numbered anew along each page, and after them the stitched ones."""
    page = Window.partitionBy(*PAGE)
    own = words.withColumn("idx", F.row_number().over(page.orderBy("idx")) - 1).select(*PAGE, "idx", "text", "x", "y", "w", "h")
    counts = own.groupBy(*PAGE).agg(F.count("*").cast("int").alias("_before"))
    more = stitched_words(own).join(counts, PAGE).withColumn("idx", F.col("_before") + F.row_number().over(page.orderBy("x", "y", "text")) - 1)
    return own.unionByName(more.select(own.columns))
