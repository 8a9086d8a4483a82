"""From pages to a project's tables: classify, extract, describe, merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions import rules, text
from plansift.operators import extract, geometry, merge
from plansift.operators.geometry import PAGE
from plansift.plans import spatial
from plansift.sources.engines import detected_types
from plansift.sources.shared import plain_plans, stored

# Fixed value: the mark of names that OCR alone bears.
TO_VERIFY = "kandydat OCR do weryfikacji"


def page_records(pages: DataFrame, types: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """All manholes that pages name, one row per record of a page (columns of spatial.manholes, with confidence and place, an int).

    Word boxes come first; lines of text only where a page has no chosen label, and not where OCR gave boxes. Then identifiers are
    normalised, heights follow from levels, confidences from what is known, names that OCR alone bears are marked, and rows of one
    record are merged.
    """
    text_pages = pages
    parts = []
    if words is not None:
        with plain_plans(pages.sparkSession):
            found = stored(spatial.manholes(pages, words, types), "spatial-manholes")
        parts.append(found)
        boxed = geometry.usable(words).select(*PAGE).distinct().join(pages.where(spatial.is_ocr(F.col("engine"))).select(*PAGE).distinct(), PAGE)
        text_pages = pages.join(found.select(*PAGE).distinct().unionByName(boxed).distinct(), PAGE, "left_anti")
    told = extract.text_manholes(extract.page_lines(text_pages))
    if words is not None:
        with plain_plans(pages.sparkSession):
            told = stored(told, "text-manholes")
    none = F.lit(None).cast("double")
    parts.append(told.withColumns({"ground_m": none, "invert_m": none, "validation_issues": F.lit("")}))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("place", "identifier")))
    rows = rows.withColumns({"identifier": text.parsed_identifier(F.col("identifier")), "height_m": F.coalesce("height_m", rules.cents(F.col("ground_m") - F.col("invert_m")))})
    facts = [F.col(c) for c in ("diameter_mm", "ground_m", "invert_m", "height_m", "type", "crown")]
    points = rules.confidence_points(*facts, F.size("transitions"))
    ocr = pages.groupBy(*PAGE).agg(F.bool_or(spatial.is_ocr(F.col("engine"))).alias("_ocr"))
    known = reduce(lambda a, b: a | b, [c.isNotNull() for c in facts[:4]], rules.filled(F.col("type")) | rules.filled(F.col("crown")) | (F.size("transitions") > 0))
    rows = rows.join(ocr, PAGE, "left").withColumn("_odd", rules.unsupported_ocr(F.col("identifier"), F.coalesce("_ocr", F.lit(False)), known))
    issue = F.when(~F.col("_odd"), F.col("validation_issues")).when(rules.filled(F.col("validation_issues")), F.concat("validation_issues", F.lit(f"; {TO_VERIFY}"))).otherwise(F.lit(TO_VERIFY))
    rows = rows.withColumns({"confidence": F.when(F.col("_odd"), F.lit("niska")).otherwise(rules.confidence(points)), "validation_issues": issue}).drop("_ocr", "_odd")
    if words is not None:
        with plain_plans(pages.sparkSession):
            rows = stored(rows, "page-rows")
    return merge.page_merged(rows, PAGE)


def page_inlets(pages: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """doc_id, page_no, identifier, raw_text, confidence: inlets of word boxes; of lines on pages without any such."""
    lines = extract.inlets(extract.page_lines(pages))
    if words is None:
        return lines
    boxes = geometry.word_inlets(words).select(*lines.columns)
    return boxes.unionByName(lines.join(boxes.select(*PAGE).distinct(), PAGE, "left_anti"))


def page_pipes(pages: DataFrame, types: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The pipes of pages: schedules of profiles, then lines (not of inlet tables, but for separators), then the clean-ups of profiles."""
    kinds = types.select("doc_id", F.col("drawing_type").alias("_kind"))
    lines = extract.line_pipes(extract.page_lines(pages)).join(kinds, "doc_id").where("_kind <> 'TABELA WPUSTÓW' OR stage = 15").drop("_kind")
    schedules = extract.schedule_pipes(pages).withColumn("line_no", F.lit(-1)).join(kinds.where("_kind = 'PROFIL'").select("doc_id"), "doc_id", "left_semi")
    pipes = stored(extract.kept_pipes(schedules.unionByName(lines)), "pipes")
    drawn = pages.join(kinds.where("_kind = 'PROFIL'").select("doc_id"), "doc_id", "left_semi")
    read = drawn.groupBy(*PAGE).agg(F.bool_or(spatial.is_ocr(F.col("engine"))).alias("_read")).where("_read").drop("_read")
    no_rows = pages.sparkSession.createDataFrame([], "doc_id string, page_no int, diameter_mm int")
    repeated = no_rows if words is None else spatial.repeated_diameter_rows(pages, words, types)
    marked = pipes.join(drawn.select(*PAGE).distinct().withColumn("_drawn", F.lit(True)), PAGE, "left").join(read.withColumn("_read", F.lit(True)), PAGE, "left")
    marked = extract.without_misread(marked, F.coalesce("_read", F.lit(False)), repeated)
    clean = extract.without_material_only(extract.without_cover_class(marked.where("_drawn"), drawn))
    return clean.unionByName(marked.where("_drawn IS NULL")).drop("_drawn", "_read")


def parsed(pages: DataFrame, files: DataFrame, words: DataFrame | None = None) -> dict[str, DataFrame]:
    """documents, records, transitions, inlets and pipes of each document. files: project_id, doc_id, ordinal, source_file.

    The type of a drawing comes from its file's name where that tells, else from its pages' text; every row bears its document's name.
    """
    types = stored(detected_types(pages, files), "types")
    docs = files.join(types, "doc_id").select("project_id", "doc_id", "ordinal", "drawing_type", text.basename(F.col("source_file")).alias("source_document"))
    rows = stored(page_records(pages, types, words), "records")
    whole = Window.partitionBy("doc_id").orderBy("page_no", "place")
    rows = rows.withColumns({"place": F.row_number().over(whole), "page": F.col("page_no"), "n_transitions": F.size("transitions")}).join(docs, "doc_id")
    records = rows.drop("page_no", "transitions")
    moved = rows.select("project_id", "doc_id", "identifier", F.explode("transitions").alias("t")).select("project_id", "doc_id", "identifier", "t.material", "t.diameter_mm", F.col("t.quantity").cast("long").alias("quantity"))
    inlets = page_inlets(pages, words).join(docs, "doc_id").withColumn("page", F.col("page_no"))
    pipes = page_pipes(pages, types, words).join(docs, "doc_id").withColumn("page", F.col("page_no"))
    return {"documents": docs, "records": records, "transitions": moved, "inlets": inlets, "pipes": pipes}


def skipped(files: DataFrame, pages: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """project_id, source_document, reason: files from which no page came, with the short form of the error where one is told."""
    rows = files.join(pages.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = rows.join(errors, "doc_id", "left") if errors is not None else rows.withColumn("error", F.lit(None).cast("string"))
    return rows.select("project_id", text.basename(F.col("source_file")).alias("source_document"), text.clipped(F.coalesce(F.trim("error"), F.lit("no page was read"))).alias("reason"))


def merged(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One set of tables per project out of all its documents. Transitions are those of records that pass the inventory's gate."""
    kept = merge.inventory_gate(tables["records"])
    named = kept.select("project_id", "doc_id", "identifier").distinct()
    moved = tables["transitions"].join(named, ["project_id", "doc_id", "identifier"], "left_semi").withColumn("identifier", text.key_of(F.col("identifier")))
    return {
        "projects": merge.set_type(tables["documents"]),
        "manholes": merge.merged_records(kept),
        "transitions": merge.merged_transitions(moved, ["project_id", "identifier"]),
        "inlets": merge.merged_inlets(tables["inlets"]),
        "pipes": merge.distinct_pipes(tables["pipes"]),
    }


def summary(manholes: DataFrame, by: list[str]) -> DataFrame:
    return manholes.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("completeness") >= 70).alias("mostly_complete"), F.count_if(F.col("completeness") == 100).alias("complete"), F.count_if(rules.filled(F.col("validation_issues"))).alias("with_issues"))
