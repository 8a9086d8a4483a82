"""Schemas of the input and result tables. A null always means: no evidence."""

from __future__ import annotations

PAGES = "doc_id string, page_no int, text string, raw_text string, ordered_text string, engine string"
WORDS = "doc_id string, page_no int, idx int, text string, x double, y double, w double, h double"
RECORD = (
    "project_id string, doc_id string, ordinal long, drawing_type string, source_document string, page int, raw_text string, identifier string, type string, diameter_mm int, "
    "ground_m double, invert_m double, height_m double, crown string, confidence string, validation_issues string, n_transitions int"
)
TRANSITIONS = "project_id string, doc_id string, identifier string, material string, diameter_mm int, quantity long"
INLETS = "project_id string, doc_id string, ordinal long, drawing_type string, source_document string, page int, raw_text string, identifier string, confidence string"
PIPES = "project_id string, doc_id string, ordinal long, drawing_type string, source_document string, page int, raw_text string, diameter_mm int, material string"
EXPECTED = "id string, dn int, height double, type string, crown string"
