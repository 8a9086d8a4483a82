"""Manholes of drawings from word boxes, in one plan: labels, what is written near them, and every rule of which source wins.

All steps are joins and aggregates on (document, page). What several of them read, and what each source of levels gives, is stored:
small plans, none of which starts over when an executor is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions import rules, text
from plansift.operators import extract, geometry, plan_levels, profile
from plansift.operators.geometry import PAGE
from plansift.sources.shared import stored

# Notes and words of results, reaches and limits.
TEXT_ONLY = "Oznaczenie znalezione w warstwie tekstowej PDF; brak pewnej kotwicy przestrzennej."
WEAK = "słaby kandydat OCR — wymaga potwierdzenia na drugim rysunku"
LOW_CROWN, HIGH_CROWN = "pierścień+płyta_odc.", "zwężka"
MATERIALS = "PVC|PYC|P¥C|PP|PE|PEHD|HDPE|PE-HD"
DIAMETER = r"(?iu)^(?:DN|D|Ø|ø)?(\d{2,4})$"


def is_ocr(engine: Column) -> Column:
    return F.coalesce(F.upper(engine).startswith("OCR/"), F.lit(False))


def page_facts(pages: DataFrame, types: DataFrame) -> DataFrame:
    """doc_id, page_no, kind (the document's drawing type), ocr, page_text."""
    facts = pages.groupBy(*PAGE).agg(F.bool_or(is_ocr(F.col("engine"))).alias("ocr"), F.first("text").alias("page_text"))
    return facts.join(types.select("doc_id", F.col("drawing_type").alias("kind")), "doc_id").select(*PAGE, "kind", "ocr", "page_text")


def all_labels(words: DataFrame) -> DataFrame:
    """page, idx, identifier, x, y, source_idx, kind, ocr: labels of one word, then of two. words: with kind and ocr."""
    profile_page = F.col("kind") == "PROFIL"
    facts = words.select(*PAGE, "kind", "ocr").distinct()
    return geometry.exact_labels(words, profile_page, F.col("ocr")).unionByName(geometry.split_labels(words, F.col("kind"))).join(facts, PAGE)


def chosen_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """The labels that stand for manholes, one per identifier: on profiles the nodes of the table, elsewhere those of most evidence."""
    on_profile = F.col("kind") == "PROFIL"
    plain = ["doc_id", "page_no", "idx", "identifier", "x", "y"]
    drawn = words.where(on_profile)
    texts = drawn.select(*PAGE, F.col("page_text").alias("text")).distinct()
    found = stored(profile.recovered(labels.where(on_profile).select(*plain), drawn, texts), "recovered")
    nodes = profile.node_rows(found, drawn)
    others = geometry.best_anchors(words.where(~on_profile), labels.where(~on_profile), F.col("kind"), F.col("ocr"))
    facts = words.select(*PAGE, "kind", "ocr").distinct()
    sources = labels.select(*PAGE, "idx", F.col("source_idx").alias("_s"))
    nodes = nodes.join(sources, [*PAGE, "idx"], "left").join(facts, PAGE)
    first = Window.partitionBy(*PAGE, "identifier").orderBy("idx")
    both = nodes.select(*plain, F.coalesce("_s", "idx").alias("source_idx"), "kind", "ocr").unionByName(others.select(*plain, "source_idx", "kind", "ocr"))
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def local_words(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """page, idx (the anchor's), word, distance and the word's box: between the neighbours' middles on profiles, else in a cell of its own.

    Sizes are shares of the page's extent, bounded (fixed values).
    """
    extent = words.groupBy(*PAGE).agg(
        F.greatest(F.lit(1.0), F.max(F.col("x") + F.greatest(F.lit(0.0), F.col("w"))) - F.min("x")).alias("width"),
        F.greatest(F.lit(1.0), F.max("y") - F.min(F.col("y") - F.greatest(F.lit(0.0), F.col("h")))).alias("height"),
    )
    anchors = anchors.join(extent, PAGE)
    nodes = geometry.neighbour_midpoints(anchors.where("kind = 'PROFIL'"), F.col("width"))
    columns = geometry.column_words(words, nodes.withColumn("_half", F.greatest(F.lit(180.0), 0.32 * F.col("height"))), F.col("_half"))
    cells = geometry.owned_words(words, anchors.where("kind <> 'PROFIL'"), reach_x=rules.clamp(0.12 * F.col("width"), 130.0, 360.0), reach_y=rules.clamp(0.12 * F.col("height"), 110.0, 260.0))
    near = columns.unionByName(cells).select(*PAGE, F.col("anchor_idx").alias("idx"), F.col("idx").alias("word"), "distance")
    boxes = geometry.centred(words).select(*PAGE, F.col("idx").alias("word"), "text", "x", "y", "h", "cx", "cy")
    at = anchors.select(*PAGE, "idx", F.col("x").alias("ax"), F.col("y").alias("ay"), "kind")
    return near.join(boxes, [*PAGE, "word"]).join(at, [*PAGE, "idx"])


def local_levels(local: DataFrame) -> DataFrame:
    """page, idx, ground_m, invert_m of the four levels nearest to each label: narrow and tall windows on profiles."""
    dx, dy = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    on_profile = F.col("kind") == "PROFIL"
    inside = F.when(on_profile, (F.abs(dx) <= 18) & (F.abs(dy) <= 105)).otherwise((F.abs(dx) <= 42) & (F.abs(dy) <= 55))
    near = local.withColumn("value", rules.elevation(F.col("text"))).where(F.col("value").isNotNull() & inside)
    return geometry.pair_of_nearest(near.select(*PAGE, "idx", "value", "distance", dx.alias("dx"), dy.alias("dy"), F.col("word").alias("at"), "kind"), on_profile)


def local_diameters(local: DataFrame) -> DataFrame:
    """page, idx, diameter_mm: the nearest plausible diameter beside a label, never on plans.

    One word with its mark; a mark and a number on one line; on profiles, where there is neither, a bare number on the label's line.
    """
    some = local.where("kind <> 'PZT'").withColumn("_t", profile.compact(F.col("text")))
    glued = some.withColumn("mm", F.regexp_extract("_t", r"(?iu)^(?:DN|D|Ø|ø)(\d{3,4})$", 1).try_cast("int")).where(rules.plausible_manhole_diameter(F.col("mm")) & (F.col("distance") <= 95))
    marks = some.where(F.trim("text").rlike("(?iu)^(?:DN|D|Ø|ø)$")).select(*PAGE, "idx", F.col("word").alias("_mark"), F.col("cx").alias("_mx"), F.col("cy").alias("_my"), F.col("h").alias("_mh"))
    numbers = some.withColumn("mm", F.regexp_replace("text", "[^0-9]", "").try_cast("int")).where(rules.plausible_manhole_diameter(F.col("mm")))
    dx, dy = F.abs(F.col("cx") - F.col("_mx")), F.abs(F.col("cy") - F.col("_my"))
    paired = numbers.join(marks, [*PAGE, "idx"]).where((dx <= 85) & (dy <= F.greatest(F.lit(22.0), 1.8 * F.greatest("h", "_mh"))) & (F.col("distance") <= 120))
    bare = numbers.where((F.col("kind") == "PROFIL") & (F.abs(F.col("cx") - F.col("ax")) <= 115) & (F.abs(F.col("cy") - F.col("ay")) <= 34))
    cost = lambda rows, stage, c: rows.select(*PAGE, "idx", "mm", F.lit(stage).alias("stage"), c.alias("cost"), "word")
    sure = cost(glued, 0, F.col("distance")).unionByName(cost(paired, 0, F.col("distance") + 0.15 * dx))
    rows = sure.unionByName(cost(bare, 1, F.col("distance") + 18))
    return rows.groupBy(*PAGE, "idx").agg(F.min_by("mm", F.struct("stage", "cost", "word")).alias("diameter_mm"))


def local_transitions(local: DataFrame) -> DataFrame:
    """page, idx, material, diameter_mm, quantity: pipes written as one word, or as a material with the nearest number; places count."""
    raw = local.withColumns({"_raw": text.extracted(F.col("text")), "_t": profile.compact(F.col("text"))})
    glued = raw.withColumns({"_m": F.regexp_extract("_t", rf"(?iu)^({MATERIALS})(?:DN|D|Ø|ø)?(\d{{2,4}})$", 1), "mm": F.regexp_extract("_t", r"(\d{2,4})$", 1).try_cast("int")}).where("_m <> ''")
    names = raw.where(F.col("_raw").rlike(rf"(?iu)^(?:{MATERIALS})$")).select(*PAGE, "idx", F.col("word").alias("_name"), F.col("_raw").alias("_m"), F.col("cx").alias("_nx"), F.col("cy").alias("_ny"), F.col("h").alias("_nh"))
    numbers = raw.withColumn("mm", F.regexp_extract("_t", DIAMETER, 1).try_cast("int")).where(F.col("mm").between(40, 2000))
    dx, dy = F.abs(F.col("cx") - F.col("_nx")), F.abs(F.col("cy") - F.col("_ny"))
    pairs = numbers.join(names, [*PAGE, "idx"]).where((dy <= F.greatest(F.lit(28.0), 2.2 * F.greatest("h", "_nh"))) & (dx <= 115))
    best = pairs.withColumn("_cost", F.struct(dx + 3 * dy, F.col("distance"), F.col("word")))
    best = best.groupBy(*PAGE, "idx", "_name").agg(F.min_by(F.struct("_m", "mm", "x", "y"), "_cost").alias("b")).select(*PAGE, "idx", "b.*")
    rows = glued.where(F.col("mm").between(40, 2000)).select(*PAGE, "idx", "_m", "mm", "x", "y").unionByName(best)
    name = text.material(F.replace(F.replace(F.upper("_m"), F.lit("PYC"), F.lit("PVC")), F.lit("P¥C"), F.lit("PVC")))
    return rows.groupBy(*PAGE, "idx", name.alias("material"), F.col("mm").alias("diameter_mm")).agg(F.count_distinct(F.rint("x"), F.rint("y")).cast("int").alias("quantity"))


def page_levels(anchors: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """page, idx, ground_m, invert_m, depth_m, column_dn: the first source that has a pair for a label.

    On profiles the rows of the whole table, then the pair of rows that most columns meet; then the text; on plans and on pages read
    by OCR, pairs by their place on pages with doubled glyphs, by their place in the stream, by their place. A depth needs rows of
    three; diameters come from the table's row, else from the strict one.
    """
    on_profile, key = F.col("kind") == "PROFIL", [*PAGE, "idx"]
    planned = (F.col("kind") == "PZT") | (F.col("ocr") & ~on_profile)
    nodes, drawn = anchors.where(on_profile).select(*PAGE, "idx", "identifier", "x", "y"), words.where(on_profile)
    wide = stored(profile.with_tolerance(nodes), "nodes")
    flat = stored(anchors.where(planned).select(*PAGE, "idx", "source_idx", "x", "y"), "plan-anchors")
    plan = words.where(planned)
    stream = extract.text_elevations(pages.select(*PAGE, "text")).join(anchors.select(*key, "identifier"), [*PAGE, "identifier"]).select(*key, "ground_m", "invert_m")
    spatial = stored(plan_levels.spatial_levels(flat, plan), "spatial")
    doubled = plan_levels.has_doubled_glyphs(plan.where("own")).where("doubled").select(*PAGE)
    geometry_ = stored(profile.elevations(wide, drawn), "rows")
    sources = [
        geometry_.select(*key, "ground_m", "invert_m"),
        stored(profile.column_levels(nodes, drawn), "column-levels"),
        stream,
        spatial.join(doubled, PAGE, "left_semi"),
        stored(plan_levels.ordered_levels(flat, plan), "ordered"),
        spatial,
    ]
    ranked = reduce(DataFrame.unionByName, [s.select(*key, F.struct(F.lit(k).alias("rank"), "ground_m", "invert_m").alias("s")) for k, s in enumerate(sources)])
    pairs = ranked.groupBy(*key).agg(F.min("s").alias("s")).select(*key, "s.ground_m", "s.invert_m")
    depths = geometry_.where("evidence >= 4").select(*key, "depth_m")
    dns = stored(profile.node_diameters(wide, drawn), "node-dns").select(*key, F.struct(F.lit(0).alias("rank"), "diameter_mm").alias("s"))
    dns = dns.unionByName(stored(profile.column_diameters(nodes, drawn), "column-dns").select(*key, F.struct(F.lit(1).alias("rank"), "diameter_mm").alias("s")))
    dns = dns.groupBy(*key).agg(F.min("s")["diameter_mm"].alias("column_dn"))
    return anchors.select(*key).join(pairs, key, "left").join(depths, key, "left").join(dns, key, "left")


def described(anchors: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """The manhole of each label (columns of page records, with score): context, diameter, height, levels, crown, transitions.

    A depth gives the height less the cover; then the text does; only without either do levels, which are filled in with it. On
    profiles a depth also tells an unnamed type, and the height an unnamed crown.
    """
    key = [*PAGE, "idx"]
    local = stored(local_words(words, anchors), "local")
    context = local.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "word", "text"))), lambda s: s["text"]), " ").alias("_c"))
    rows = anchors.join(context, key, "left").withColumn("_c", text.extracted(F.coalesce("_c", F.lit(""))))
    rows = rows.withColumn("raw_text", F.when(F.trim("_c") == "", F.col("identifier")).otherwise(F.col("_c")))
    rows = rows.join(stored(page_levels(anchors, words, pages), "levels"), key, "left")
    rows = rows.join(local_levels(local).withColumnsRenamed({"ground_m": "_lg", "invert_m": "_li"}), key, "left").join(local_diameters(local).withColumnRenamed("diameter_mm", "_ldn"), key, "left")
    told = extract.described("raw_text")
    named = F.col("raw_text").rlike(r"(?iu)\b(?:studnia|studzienka)\b")
    rows = rows.withColumns({"type": told["type"], "crown": told["crown"], "diameter_mm": F.coalesce("column_dn", "_ldn", F.when(named, told["diameter_mm"]))})
    height = F.coalesce(rules.cents(rules.height_of_depth(F.col("depth_m"))), told["height_m"])
    rows = rows.withColumn("_h", height)
    pair = F.when(F.col("_h").isNull(), F.when(F.col("ground_m").isNotNull(), F.struct(F.col("ground_m").alias("g"), F.col("invert_m").alias("i"))).when(F.col("_lg").isNotNull(), F.struct(F.col("_lg").alias("g"), F.col("_li").alias("i"))))
    rows = rows.withColumn("_p", pair).withColumns({"ground_m": F.col("_p.g"), "invert_m": F.col("_p.i"), "height_m": F.coalesce("_h", rules.cents(F.col("_p.g") - F.col("_p.i")))})
    deep = (F.col("kind") == "PROFIL") & F.col("depth_m").isNotNull()
    flow = F.when(deep & ~F.col("raw_text").rlike("(?iu)osadnik"), F.lit("kinetowa"))
    cover = F.when(deep & F.col("height_m").isNotNull(), F.when(F.col("height_m") <= 1.1, LOW_CROWN).otherwise(HIGH_CROWN))
    rows = stored(rows.withColumns({"type": F.coalesce("type", flow), "crown": F.coalesce("crown", cover)}).drop("_p"), "described")
    moved = stored(with_transitions(rows, local), "transitions")
    scores = stored(geometry.evidence(words, anchors, F.when(F.col("kind") == "PROFIL", 420.0).otherwise(300.0)).select(*key, "score"), "scores")
    scored = rows.join(moved, key, "left").join(scores, key)
    scored = scored.withColumn("transitions", F.coalesce("transitions", F.array().cast(extract.TRANSITIONS)))
    weak = rules.weak_candidate(F.col("ocr"), F.col("score"), F.col("ground_m"), F.col("diameter_mm"), F.size("transitions"))
    place = F.struct(F.lit(0).alias("stage"), F.col("idx").cast("double").alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    return scored.select(*PAGE, "identifier", "raw_text", "type", "diameter_mm", "ground_m", "invert_m", "height_m", "crown", "transitions", F.when(weak, F.lit(WEAK)).otherwise(F.lit("")).alias("validation_issues"), place.alias("place"))


def with_transitions(rows: DataFrame, local: DataFrame) -> DataFrame:
    """page, idx, transitions: of what the context names and what stands near, the larger count; never the manhole's own diameter."""
    key = [*PAGE, "idx"]
    in_text = extract.transitions(rows, "raw_text", key).withColumn("quantity", F.col("quantity").cast("int"))
    both = in_text.unionByName(local_transitions(local)).groupBy(*key, "material", "diameter_mm").agg(F.max("quantity").alias("quantity"))
    both = both.join(rows.select(*key, F.col("diameter_mm").alias("_dn")), key).where(F.col("_dn").isNull() | (F.col("diameter_mm") != F.col("_dn")) | (F.col("diameter_mm") < 800))
    return both.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("material", "diameter_mm", "quantity"))).cast(extract.TRANSITIONS).alias("transitions"))


def profile_family(anchors: DataFrame) -> DataFrame:
    """page, family: the letters that a profile's nodes bear, by which names in its text are restricted: KD beside KDIST and two KD, else
    the first of KD, KS and K with three nodes."""
    of = lambda letters, more="": F.count_if(F.col("identifier").rlike(rf"^{letters}\d+{more}$"))
    index = r"(?:[./-]\d+)*"
    counts = anchors.where("kind = 'PROFIL'").groupBy(*PAGE).agg(F.bool_or(F.col("identifier") == "KDIST").alias("marker"), of("KD").alias("plain"), *[of(p, index).alias(p) for p in ("KD", "KS", "K")])
    family = F.when(F.col("marker") & (F.col("plain") >= 2), "KD").when(F.col("KD") >= 3, "KD").when(F.col("KS") >= 3, "KS").when(F.col("K") >= 3, "K")
    return counts.select(*PAGE, family.alias("family")).where("family IS NOT NULL")


def text_only(pages: DataFrame, raw_words: DataFrame, labels: DataFrame, anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """Manholes that a page with labels names without a label that was chosen (columns of page records).

    Names come from the text, from the words in their order, and from labels that were not chosen; a profile's family restricts them.
    Read by OCR, a name needs a pair of levels or a second mention.
    """
    told = facts.where(rules.filled(F.col("page_text"))).join(anchors.select(*PAGE).distinct(), PAGE, "left_semi")
    counts = extract.identifier_counts(pages.select(*PAGE, "text"))
    stream = raw_words.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), " ").alias("text"))
    names = reduce(DataFrame.unionByName, [df.select(*PAGE, "identifier") for df in (counts, extract.identifier_counts(stream), labels)]).distinct()
    rows = names.join(told, PAGE).join(profile_family(anchors), PAGE, "left")
    kin = F.col("identifier").rlike(r"^[A-Z]+\d") & (F.regexp_extract("identifier", r"^([A-Z]+)\d+(?:[./-]\d+)*$", 1) == F.col("family"))
    rows = rows.where(F.col("family").isNull() | kin | ((F.col("family") == "KD") & (F.col("identifier") == "KDIST")))
    rows = rows.join(anchors.select(*PAGE, "identifier"), [*PAGE, "identifier"], "left_anti")
    rows = rows.join(extract.text_elevations(pages.select(*PAGE, "text")), [*PAGE, "identifier"], "left").join(counts, [*PAGE, "identifier"], "left")
    rows = rows.where(~F.col("ocr") | F.col("ground_m").isNotNull() | (F.col("n") >= 2))
    null = lambda t: F.lit(None).cast(t)
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("identifier")).cast("double")
    place = F.struct(F.lit(1).alias("stage"), order.alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    return rows.select(
        *PAGE, "identifier", F.lit(TEXT_ONLY).alias("raw_text"), null("string").alias("type"), null("int").alias("diameter_mm"), "ground_m", "invert_m",
        rules.cents(F.col("ground_m") - F.col("invert_m")).alias("height_m"), null("string").alias("crown"), F.array().cast(extract.TRANSITIONS).alias("transitions"), F.lit("").alias("validation_issues"), place.alias("place"),
    )


def prepared(pages: DataFrame, words: DataFrame, types: DataFrame) -> DataFrame:
    """Usable words and the stitched ones after them, with kind, ocr and page_text; own tells a page's own words."""
    facts = page_facts(pages, types)
    usable = geometry.usable(words)
    n = usable.groupBy(*PAGE).agg(F.count("*").alias("_own"))
    rows = geometry.with_stitched(usable).join(n, PAGE).withColumn("own", F.col("idx") < F.col("_own")).drop("_own")
    return stored(rows.join(facts, PAGE), "words")


def manholes(pages: DataFrame, words: DataFrame, types: DataFrame) -> DataFrame:
    """doc_id, page_no, identifier, raw_text, type, diameter_mm, ground_m, invert_m, height_m, crown, transitions, validation_issues, place.

    pages: doc_id, page_no, text, engine; words: boxes by page; types: doc_id, drawing_type. Pages without a credible label give no
    rows; place orders a page's rows.
    """
    ready = prepared(pages, words, types)
    labels = stored(all_labels(ready), "labels")
    anchors = stored(chosen_labels(labels, ready), "anchors")
    found = described(anchors, ready, pages)
    own = labels.join(ready.where("own").select(*PAGE, "idx"), [*PAGE, "idx"], "left_semi")
    return found.unionByName(stored(text_only(pages, words, own, anchors, page_facts(pages, types)), "text-only"))


def repeated_diameter_rows(pages: DataFrame, words: DataFrame, types: DataFrame) -> DataFrame:
    """page, diameter_mm: on profiles read by OCR, a diameter that stands twice on a row, once beside a label: a row of the manholes' own."""
    rows = words.join(page_facts(pages, types).where("ocr AND kind = 'PROFIL'"), PAGE)
    labels = all_labels(rows)
    token = F.upper(profile.compact(F.col("text")))
    digits = F.translate(F.regexp_extract(token, r"^(?:DN|D|Ø)([0-9OIL|]{2,4})$", 1), "OIL|", "0111")
    items = geometry.centred(rows).withColumn("diameter_mm", digits.try_cast("int")).where("diameter_mm IS NOT NULL").select(*PAGE, "idx", "diameter_mm", "x", "h", "cx", "cy")
    beside = items.join(labels.select(*PAGE, F.col("x").alias("_ax")), PAGE).where(F.abs(F.col("cx") - F.col("_ax")) <= 75).select(*PAGE, "idx").distinct().withColumn("_beside", F.lit(True))
    others = items.join(beside, [*PAGE, "idx"], "left").select(*PAGE, "diameter_mm", F.col("x").alias("_ox"), F.col("cy").alias("_oy"), F.coalesce("_beside", F.lit(False)).alias("_beside"))
    row = items.join(others, [*PAGE, "diameter_mm"]).where(F.abs(F.col("cy") - F.col("_oy")) <= F.greatest(F.lit(8.0), F.col("h")))
    sums = row.groupBy(*PAGE, "diameter_mm", "idx").agg(F.count_distinct(F.rint(F.col("_ox") / 20)).alias("_n"), F.bool_or("_beside").alias("_b"))
    return sums.where("_n >= 2 AND _b").select(*PAGE, "diameter_mm").distinct()
