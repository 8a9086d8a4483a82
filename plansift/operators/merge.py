"""Merging records of one object from several drawings, without folding rows by hand.

Rows carry a priority (plan, profile, others) and an ordinal; "first non-null wins", overrides and conflicts are window expressions
over that order, so a group is never gathered into one value except for its few issues and notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions import rules, text
from plansift.operators.extract import summed

# Tolerances of the merge.
ELEVATION_TOLERANCE, HEIGHT_TOLERANCE, INVENTORY = 0.03, 0.05, 6


def priority(drawing_type: Column) -> Column:
    kind = F.upper(drawing_type)
    return F.when(kind == "PZT", 0).when(kind == "PROFIL", 1).otherwise(2)


def inventory_gate(records: DataFrame, group: str = "project_id") -> DataFrame:
    """Rows that count: with at least INVENTORY plan identifiers, another drawing's row needs to be among them, to have two of four
    field groups, or to be named in two profiles."""
    rows = records.withColumn("_key", text.key_of(F.col("identifier")))
    plan, profile = F.upper("drawing_type") == "PZT", F.upper("drawing_type") == "PROFIL"
    named = rows.where(F.col("_key") != "")
    counts = named.groupBy(group).agg(F.count_distinct(F.when(plan, F.col("_key"))).alias("_plan_ids"))
    ids = named.groupBy(group, "_key").agg(F.max(plan.cast("int")).alias("_on_plan"), F.count_distinct(F.when(profile, text.basename(F.col("source_document")))).alias("_profiles"))
    fields = [F.col("diameter_mm").isNotNull(), F.col("ground_m").isNotNull() & F.col("invert_m").isNotNull(), rules.filled(F.col("type")) | rules.filled(F.col("crown")), F.coalesce(F.col("n_transitions"), F.lit(0)) > 0]
    n = sum((f.cast("int") for f in fields[1:]), fields[0].cast("int"))
    rows = rows.join(counts, group, "left").join(ids, [group, "_key"], "left")
    keep = (F.coalesce(F.col("_plan_ids"), F.lit(0)) < INVENTORY) | plan | (F.coalesce(F.col("_on_plan"), F.lit(0)) == 1) | (n >= 2) | (F.coalesce(F.col("_profiles"), F.lit(0)) >= 2)
    return rows.where(keep).select(records.columns)


def with_order(records: DataFrame, group: str, ordinal: str) -> DataFrame:
    """_key (never blank: a row without an identifier stays by itself) and _ord, the order of sources: by drawing type, document, and
    the place in the document (column place, where records have it), at last by all columns, so that no two rows are alike."""
    own = F.xxhash64(*[F.col(c) for c in records.columns])
    place = F.col("place") if "place" in records.columns else F.lit(0)
    key = text.key_of(F.col("identifier"))
    alone = F.concat_ws("\0", F.lit(""), F.col("drawing_type"), F.col(ordinal).cast("string"), place.cast("string"), own.cast("string"))
    order = F.struct(priority(F.col("drawing_type")).alias("p"), F.col(ordinal).alias("o"), place.alias("at"), own.alias("row"))
    return records.withColumn("_key", F.when(key == "", alone).otherwise(key)).withColumn("_ord", order)


def page_groups(records: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, note (the joined raw texts) and rows (the values of `order`, ascending) of each record that a page's rows make.

    A row joins the first record with its identifier, or whose notes so far are its raw text, whatever the case; else it is a new
    one. So the fold goes over a page's rows in their order, with identifiers and notes alone.
    """
    one = F.struct(F.col(order).alias("at"), F.upper(F.trim(F.coalesce("identifier", F.lit("")))).alias("id"), F.trim(F.coalesce("raw_text", F.lit(""))).alias("raw"))
    pages = records.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("_l"))
    at = records.schema[order].dataType.simpleString()
    shape = f"array<struct<id:string,raw:string,rows:array<{at}>>>"

    def step(acc: Column, r: Column) -> Column:
        same = lambda m: ((r["id"] != "") & (m["id"] == r["id"])) | ((r["raw"] != "") & (F.upper(m["raw"]) == F.upper(r["raw"])))
        place = F.array_position(F.transform(acc, same), True)
        grown = lambda m: F.when(F.upper(m["raw"]) == F.upper(r["raw"]), m["raw"]).when(m["raw"] == "", r["raw"]).otherwise(F.concat(m["raw"], F.lit(" | "), r["raw"]))
        joined = F.transform(acc, lambda m, i: F.when(i == place - 1, F.struct(m["id"].alias("id"), grown(m).alias("raw"), F.concat(m["rows"], F.array(r["at"])).alias("rows"))).otherwise(m))
        return F.when(place > 0, joined.cast(shape)).otherwise(F.concat(acc, F.array(F.struct(r["id"].alias("id"), r["raw"].alias("raw"), F.array(r["at"]).alias("rows")))).cast(shape))

    return pages.select(*by, F.explode(F.aggregate("_l", F.array().cast(shape), step)).alias("g")).select(*by, F.col("g.raw").alias("note"), F.col("g.rows").alias("rows"))


def page_merged(records: DataFrame, by: list[str], order: str = "place") -> DataFrame:
    """One row per record of a page (see page_groups): what is set first wins, diameters and heights only if positive; the best
    confidence; transitions (arrays) added up; raw texts joined. order: a column without ties on a page, which stays."""
    groups = page_groups(records, by, order).select(*by, "note", F.element_at("rows", 1).alias("_first"), F.explode("rows").alias(order))
    rows = records.join(groups, [*by, order])
    set_ = lambda c, when: F.min_by(c, F.when(when, F.col(order))).alias(c)
    plain = {"type": rules.filled(F.col("type")), "crown": rules.filled(F.col("crown")), "ground_m": F.col("ground_m").isNotNull(), "invert_m": F.col("invert_m").isNotNull()}
    # the first row's own values stay even where they aren't positive
    own = F.col(order) == F.col("_first")
    positive = {c: F.col(c).isNotNull() & (own | (F.col(c) > 0)) for c in ("diameter_mm", "height_m")}
    rank = F.struct(-rules.confidence_rank(F.col("confidence")), F.col(order))
    rest = [c for c in records.columns if c not in (*by, order, *plain, *positive, "confidence", "transitions", "raw_text")]
    out = rows.groupBy(*by, "_first").agg(
        *[F.min_by(c, order).alias(c) for c in rest], *[set_(c, w) for c, w in {**plain, **positive}.items()],
        F.min_by("confidence", rank).alias("confidence"), F.min("note").alias("raw_text"), F.flatten(F.collect_list("transitions")).alias("transitions"),
    )
    return out.withColumn("transitions", summed("transitions")).withColumnRenamed("_first", order).select(records.columns)


def running(records: DataFrame, group: str = "project_id", ordinal: str = "ordinal") -> DataFrame:
    """records plus, per row, what the merged record holds before it and the issues that the row raises (array, in order)."""
    rows = with_order(records, group, ordinal)
    w = Window.partitionBy(group, "_key").orderBy("_ord")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.row_number().over(w))
    drop = F.col("ground_m") - F.col("invert_m")
    pair = F.coalesce((F.col("_n") > 1) & (F.upper("drawing_type") == "PROFIL") & drop.between(0.35, 8.0), F.lit(False))
    rows = rows.withColumn("_pair", pair)
    rows = rows.withColumn("_pair_height", F.coalesce("height_m", rules.cents(drop)))
    held = {}
    for name, own in (("ground_m", "ground_m"), ("invert_m", "invert_m"), ("height_m", "_pair_height")):
        held[name] = F.coalesce(F.last(F.when(F.col("_pair"), F.col(own)), ignorenulls=True).over(past), F.first(name, ignorenulls=True).over(past))
    rows = rows.withColumns({f"_held_{k}": v for k, v in held.items()} | {"_held_dn": F.first("diameter_mm", ignorenulls=True).over(past)})
    two = lambda what, a, b: F.format_string(f"{what}: %.2f / %.2f", a, b)
    apart = lambda name, limit: ~F.col("_pair") & (F.abs(F.col(f"_held_{name}") - F.col(name)) > limit)
    issues = [
        F.when(F.col("_held_dn") != F.col("diameter_mm"), F.format_string("sprzeczne DN: %d / %d", "_held_dn", "diameter_mm")),
        F.when(apart("ground_m", ELEVATION_TOLERANCE), two("sprzeczna rzędna góry", F.col("_held_ground_m"), F.col("ground_m"))),
        F.when(apart("invert_m", ELEVATION_TOLERANCE), two("sprzeczna rzędna dna", F.col("_held_invert_m"), F.col("invert_m"))),
        F.when(apart("height_m", HEIGHT_TOLERANCE), two("sprzeczna wysokość", F.col("_held_height_m"), F.col("height_m"))),
    ]
    return rows.withColumn("_issues", F.filter(F.array(*issues), lambda x: x.isNotNull()))


def appended(parts: Column, separator: str) -> Column:
    """Texts joined in order, each only if what is there doesn't contain it, whatever the case; blanks are left out."""
    step = lambda acc, x: F.when((F.trim(x) == "") | x.isNull(), acc).when(acc == "", x).when(F.contains(F.lower(acc), F.lower(x)), acc).otherwise(F.concat(acc, F.lit(separator), x))
    return F.aggregate(parts, F.lit(""), step)


def in_order(value: Column, order: str = "_ord") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda s: s["v"])


def distinct_ci(names: Column) -> Column:
    """First occurrences, whatever the case, order kept; blanks left out."""
    some = F.filter(names, lambda s: s.isNotNull() & (F.trim(s) != ""))
    return F.filter(some, lambda s, i: F.array_position(F.transform(some, F.lower), F.lower(s)) == i + 1)


def first_notes(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, raw_text (joined, see appended) and source_documents: of equal texts, whatever the case, the first alone is gathered.

    rows are dealt by `by` already, so neither aggregate moves them.
    """
    each = rows.select(*by, "_ord", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(("raw_text", "source_document"))])).alias("n"))
    each = each.where(F.col("n.v").isNotNull()).groupBy(*by, F.col("n.k").alias("_kind"), F.lower("n.v").alias("_low")).agg(F.min(F.struct("_ord", F.col("n.v").alias("v"))).alias("f"))
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.col("f")))), lambda s: s["v"])
    return each.groupBy(*by).agg(appended(listed(0), " | ").alias("raw_text"), distinct_ci(listed(1)).alias("source_documents"))


def merged_records(records: DataFrame, group: str = "project_id", ordinal: str = "ordinal") -> DataFrame:
    """One row per object of a project, with completeness and confidence. Columns of records: see model.RECORD."""
    rows = running(records, group, ordinal)
    first = lambda c, when=None: F.min_by(c, F.when(c.isNotNull() if when is None else when, F.col("_ord")))
    last_pair = lambda c: F.max_by(c, F.when(F.col("_pair"), F.col("_ord")))
    rank = rules.confidence_rank(F.col("confidence"))
    best = F.max_by("confidence", F.struct(rank, (-F.col("_n")).alias("n")))
    out = rows.groupBy(group, "_key").agg(
        F.max("_n").alias("n_records"),
        F.min_by(text.key_of(F.col("identifier")), F.col("_ord")).alias("identifier"),
        first(F.col("page"), F.col("page") > 0).alias("page"),
        first(F.col("type"), rules.filled(F.col("type"))).alias("type"),
        first(F.col("crown"), rules.filled(F.col("crown"))).alias("crown"),
        first(F.col("diameter_mm")).alias("diameter_mm"),
        F.coalesce(last_pair(F.col("ground_m")), first(F.col("ground_m"))).alias("ground_m"),
        F.coalesce(last_pair(F.col("invert_m")), first(F.col("invert_m"))).alias("invert_m"),
        F.coalesce(last_pair(F.col("_pair_height")), first(F.col("height_m"))).alias("height_m"),
        appended(F.flatten(F.filter(in_order(F.when(F.size("_issues") > 0, F.col("_issues"))), lambda x: x.isNotNull())), "; ").alias("_found"),
        F.min_by("validation_issues", "_ord").alias("_known"),
        best.alias("confidence"),
        F.max("n_transitions").alias("n_transitions"),
    )
    out = out.join(first_notes(rows, [group, "_key"]), [group, "_key"])
    issues = appended(F.array(F.coalesce("_known", F.lit("")), F.col("_found")), "; ")
    out = out.withColumn("validation_issues", issues)
    out = out.withColumn("confidence", F.when((F.col("n_records") > 1) & (F.col("validation_issues") != ""), F.lit("niska")).otherwise(F.col("confidence")))
    derived = rules.cents(F.col("ground_m") - F.col("invert_m"))
    out = out.withColumn("height_m", F.coalesce("height_m", F.when((derived > 0) & (derived < 30), derived)))
    flags = rules.present(*[F.col(c) for c in ("identifier", "diameter_mm", "ground_m", "invert_m", "height_m", "type", "crown", "n_transitions")])
    out = out.withColumns({"completeness": rules.completeness(flags), "missing": rules.missing(flags)})
    out = out.withColumn("confidence", rules.upgraded(F.col("confidence"), F.size("source_documents"), F.col("completeness"), F.col("validation_issues")))
    return out.drop("_key", "_found", "_known")


def merged_transitions(transitions: DataFrame, by: list[str], how: str = "max") -> DataFrame:
    """Quantities per material and diameter: summed within one document, the largest across documents."""
    rows = transitions.withColumn("material", text.material(F.col("material")))
    quantity = F.sum("quantity") if how == "sum" else F.max("quantity")
    return rows.groupBy(*by, "material", "diameter_mm").agg(quantity.alias("quantity"))


def merged_inlets(inlets: DataFrame, group: str = "project_id", ordinal: str = "ordinal") -> DataFrame:
    """One row per inlet identifier (WP in front), best confidence, sources in order; blank identifiers are one."""
    rows = inlets.withColumns({"identifier": text.inlet_key(F.col("identifier")), "_ord": F.struct(priority(F.col("drawing_type")).alias("p"), F.col(ordinal).alias("o"))})
    rank = F.struct(-rules.confidence_rank(F.col("confidence")), "_ord")
    by = [group, "identifier"]
    return rows.groupBy(*by).agg(F.min_by("confidence", rank).alias("confidence")).join(first_notes(rows, by), by)


def distinct_pipes(pipes: DataFrame, group: str = "project_id", ordinal: str = "ordinal") -> DataFrame:
    """The first of pipes with equal diameter (null too), material and text, white space and case apart."""
    rows = pipes.withColumn("_ord", F.struct(priority(F.col("drawing_type")).alias("p"), F.col(ordinal).alias("o")))
    w = Window.partitionBy(group, "diameter_mm", F.upper("material"), text.loose(F.col("raw_text"))).orderBy("_ord")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(pipes.columns)


def set_type(projects: DataFrame, group: str = "project_id", ordinal: str = "ordinal") -> DataFrame:
    """The type of a set of drawings: its one known type, or all known ones in order."""
    rows = projects.withColumn("_ord", F.struct(priority(F.col("drawing_type")).alias("p"), F.col(ordinal).alias("o")))
    known = rows.where(rules.filled(F.col("drawing_type")) & (F.upper("drawing_type") != "NIEZNANY"))
    firsts = known.groupBy(group, F.upper("drawing_type").alias("_t")).agg(F.min(F.struct("_ord", "drawing_type")).alias("f"))
    types = firsts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list("f")), lambda s: s["drawing_type"]).alias("t"))
    name = F.when(F.coalesce(F.size("t"), F.lit(0)) < 1, "NIEZNANY").when(F.size("t") == 1, F.get("t", F.lit(0))).otherwise(F.concat(F.lit("ZESTAW: "), F.array_join("t", " + ")))
    return rows.select(group).distinct().join(types, group, "left").select(group, name.alias("drawing_type"))
