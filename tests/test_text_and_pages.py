"""Normalisers, extraction, word boxes, sources and sinks on small inputs with the results known."""

import zipfile
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plansift import model
from plansift.functions import rules, text
from plansift.operators import extract, geometry, rows
from plansift.plans import project
from plansift.sources import cache, engines, sinks, tiles


def values(spark, column, *inputs):
    return [r[0] for r in spark.createDataFrame([(i,) for i in inputs], "v string").select(column(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "column,pairs",
    [
        (text.extracted, {"0,0Studnia": "0,0 Studnia", "PVC200": "PVC 200", "a\r\nb\u00a0 c": "a b c", "PYC 200": "PVC 200", "rura DN200PVC": "rura DN 200 PVC", "KD5": "KD 5"}),
        (text.halved, {"66//11": "6/1", "DD": "D", "6/1": "6/1", "112": "112", "": ""}),
        (text.spatial_token, {" (D 5), ": "D5", "[DD]": "D"}),
        (text.identifier_number, {"007": "7", "06/01": "6/1", "0": "0", "10.05": "10.5"}),
        (text.parsed_identifier, {"kd007": "KD7", "so": "SO", " x9 ": "X9", "D06/1": "D6/1"}),
        (text.manhole_type, {"Kinetowa": "kinetowa", "z osadnikiem": "osadnikowa", " inna ": "inna"}),
        (text.material, {"pehd": "PE-HD", "HDPE": "PE-HD", " pvc ": "PVC"}),
        (text.folded, {"Zwężka_bet. +": "zwezkabet"}),
        (text.basename, {r"c:\a\b.pdf": "b.pdf", "x/y.z": "y.z", "q": "q"}),
        (text.sort_key, {"d6/1": "D000006.000002", "": "ZZZ999999", "KD12": "KD000012.000000", "so": "SO999999.000000"}),
        (text.shown_sort_key, {"d6/1": "D000006.000002", "": "ZZZ999999", "KD12/1/2": "KD12/1/2", "so": "SO999999.000000"}),
        (text.ocr_token, {" DI7": "D17", "K—1": "K-1", "P¥C160": "PVC160", "PVCI160": "PVC160", "DIL": "DIL"}),
        (rules.drawing_type_of_name, {"x/PZT profil.pdf": "PZT", r"c:\PZT\a profil.pdf": "PROFIL", "b/Podłużny.pdf": "PROFIL", "plan sytuacyjny.pdf": "PZT", "PZT/a.pdf": None}),
        (rules.elevation, {"62,77": 62.77, "60,4]": 60.41, "6622,,7777": 62.77, "19,99": None, "abc": None, "(I26.47)": 126.47}),
        (rules.likely_identifier, {"KDIST": True, "SO": True, "D5": True, "KS200": False, "S3/2025": False, "D59.93": False, "D6/1": True, "X1": False}),
        (rules.drawing_type, {"x [[ABC_DRAWING:PZT]] PROFIL PODŁUŻNY": "PZT", "rzędne dna przewodu": "PROFIL", "Plan sytuacyjno": "PZT", "RZĘDNA DNA STUDZIENKI, rzędna wlotu, DŁUGOŚĆ PRZYKANALIKÓW": "TABELA WPUSTÓW", "": "NIEZNANY"}),
        (extract.likely_diameter, {"Studnia betonowa DN1500, rura DN1000": 1500, "DN1013 DN2000 DN1200": 1200, "DN3500": 3500, "PVC 200": None}),
    ],
)
def test_columns(spark, column, pairs):
    assert values(spark, column, *pairs) == list(pairs.values())


def pages(spark, *texts, engine=""):
    return spark.createDataFrame([("d", n, t, None, None, engine) for n, t in enumerate(texts, 1)], model.PAGES)


def test_manholes_and_inlets_of_lines(spark):
    lines = extract.page_lines(pages(spark, "D1 studnia DN1200\nD2 studnia DN1200\nKD3 studnia DN1000", "Tabela wpustów\nW0\nW1\nW8\nWP 12", "szerokość w 200 mm, elementy w2 rzędach"))
    assert sorted((r["page_no"], r["identifier"]) for r in extract.manholes(lines).collect()) == [(1, "D1"), (1, "D2"), (1, "KD3")]
    assert sorted((r["page_no"], r["identifier"]) for r in extract.inlets(lines).collect()) == [(2, "WP0"), (2, "WP1"), (2, "WP12"), (2, "WP8")]


def test_equal_streams_count_once(spark):
    df = spark.createDataFrame([("d", 1, "D1", "D1", "D2", "")], model.PAGES)
    assert [r["line"] for r in extract.page_lines(df).orderBy("line_no").collect()] == ["D 1", "D 2"]


def test_a_described_manhole(spark):
    df = pages(spark, "D5 Studnia kinetowa DN2000 wys. całk. 4,50 m zwieńczenie właz żeliwny PVC DN200 PVC DN200 PP DN300")
    r = df.select(*[c.alias(n) for n, c in extract.described("text").items()]).first()
    assert (r["type"], r["height_m"], r["diameter_mm"]) == ("kinetowa", 4.5, 2000) and r["crown"].startswith("zwieńczenie właz")
    moved = {(x["material"], x["diameter_mm"]): x["quantity"] for x in extract.transitions(df, "text", ["doc_id"]).collect()}
    assert moved == {("PVC", 200): 2, ("PP", 300): 1}


def test_schedules(spark):
    found = lambda t: sorted((r["material"], r["diameter_mm"]) for r in extract.schedule_pipes(pages(spark, t)).collect())
    assert found("PVC-U_SDR34_l\n200×5,9\nPVC-U_SDR34_l\n250×7,3\nwłaz klasa D 400") == [("PVC", 200), ("PVC", 250)]
    assert found("D 300 betonowe typu „WIPRO”\nD400\nbetonowe typu WIPRO") == [("BETON", 300), ("BETON", 400)]
    assert found("PVC-U rury\n200\n0,5 %\nPE rury\n315\n1,0 %") == [("PVC", 200)]
    assert found("Dz 160 mm PVC") == [("PVC", 160)]


def test_pipe_cleanups(spark):
    p = pages(spark, "PVC 200 i PP\nwłaz klasa D 400 PVC")
    pipes = extract.line_pipes(extract.page_lines(p))
    kept = extract.without_material_only(extract.without_cover_class(pipes, p))
    assert ("PVC", 200) in {(r["material"], r["diameter_mm"]) for r in kept.collect()}
    assert not [r for r in kept.collect() if r["diameter_mm"] == 400]


def test_last_elevations_win(spark):
    r = extract.text_elevations(pages(spark, "D5 50,00 52,00\nD05 58,25 60,50 D6 60,00 60,10")).collect()
    assert [(x["identifier"], x["ground_m"], x["invert_m"]) for x in r] == [("D5", 60.5, 58.25)]


def test_project_from_text(spark):
    texts = [("a", 1, "Plan sytuacyjno\nD5 studnia\nD5 60,50 58,25\nWP3", None, None, ""), ("b", 1, "PROFIL sieci KANALIZACJI\nD5 Studnia kinetowa DN1200 PVC DN200\nwłaz", None, None, "")]
    files = spark.createDataFrame([("p", "a", 0, "x/a.pdf"), ("p", "b", 1, "x/b.pdf")], "project_id string, doc_id string, ordinal long, source_file string")
    out = project.merged(project.parsed(spark.createDataFrame(texts, model.PAGES), files))
    r = out["manholes"].collect()
    # levels in text count beside a label alone, and these pages have no word boxes
    assert [(x["identifier"], x["ground_m"], x["height_m"], x["diameter_mm"], x["type"], x["n_transitions"]) for x in r] == [("D5", None, None, 1200, "kinetowa", 1)]
    assert [(x["material"], x["diameter_mm"], x["quantity"]) for x in out["transitions"].collect()] == [("PVC", 200, 1)]
    assert [x["source_document"] for x in project.skipped(files.unionByName(files.limit(1).selectExpr("project_id", "'c' AS doc_id", "9L AS ordinal", "'x/c.pdf' AS source_file")), spark.createDataFrame(texts, model.PAGES)).collect()] == ["c.pdf"]
    assert out["projects"].first()["drawing_type"] == "ZESTAW: PZT + PROFIL"
    assert [x["identifier"] for x in out["inlets"].collect()] == ["WP3"]
    assert project.summary(out["manholes"], ["project_id"]).first()["total"] == 1


def words(spark, *boxes):
    return spark.createDataFrame([("d", 1, k, t, float(x), float(y), float(w), float(h)) for k, (t, x, y, w, h) in enumerate(boxes)], model.WORDS)


def test_split_labels(spark):
    w = words(spark, ("D", 885, 1903, 15, 20), ("6/1", 900, 1901, 20, 14), ("133,55", 860, 1892, 23, 8), ("126,47", 860, 1901, 23, 8), ("D7", 882, 1910, 10, 8))
    assert [r["identifier"] for r in geometry.split_labels(w, "PZT").collect()] == ["D6/1"]
    assert [r["identifier"] for r in geometry.exact_labels(w, profile=False).collect()] == ["D7"]
    doubled = words(spark, ("DD", 885, 1903, 15, 20), ("66//11", 900, 1901, 20, 14), ("DD", 873, 1944, 15, 20), ("77", 888, 1943, 8, 14))
    assert sorted(r["identifier"] for r in geometry.split_labels(doubled, "PZT").collect()) == ["D6/1", "D7"]


def test_stitched_words(spark):
    w = words(spark, ("1", 860, 1901, 4, 8), ("2", 864, 1901.2, 4, 8), ("6,47", 868, 1900.8, 15, 8), ("9", 950, 1901, 4, 8), ("13", 100, 50, 8, 8), ("3,55", 116, 50, 15, 8), ("60,4]", 300, 50, 20, 8))
    found = {(r["text"], r["x"], r["w"]) for r in geometry.stitched_words(w).collect()}
    assert found == {("126,47", 860.0, 23.0), ("26,47", 864.0, 19.0), ("60,4]", 300.0, 20.0)}  # the gap beside 13 is too wide
    assert [r["idx"] for r in geometry.with_stitched(w).orderBy("idx").collect()] == list(range(10))


def test_misread_branch_labels(spark):
    w = words(spark, ("KS21", 1366, 1134, 24, 10), ("KSe.1", 1370, 1136, 24, 10), ("s31", 1512, 1134, 24, 10), ("KS3", 1492, 1134, 24, 10), ("KS21", 100, 1134, 24, 10), ("S31", 100, 500, 24, 10), ("KDI", 1, 1, 9, 9))
    read = lambda on: [r["_t"] for r in geometry.repaired_tokens(w, F.lit(on)).orderBy("idx").collect()]
    assert read(True) == ["KS2.1", "KS2.1", "KS3.1", "KS3", "KS21", "S31", "KD1"]
    assert read(False) == ["KS21", "KSE.1", "S31", "KS3", "KS21", "S31", "KDI"]


def test_materials_with_numbers(spark):
    w = words(spark, ("PVC", 100, 100, 20, 10), ("DN200", 125, 100, 20, 10), ("PP300", 100, 300, 20, 10), ("PVC", 400, 100, 20, 10), ("200", 425, 100, 20, 10))
    assert sorted((r["material"], r["diameter_mm"], r["quantity"]) for r in geometry.local_materials(w).collect()) == [("PP", 300, 1), ("PVC", 200, 2)]


def test_evidence(spark):
    anchors = spark.createDataFrame([("d", 1, 0, "D1", 100.0, 100.0), ("d", 1, 1, "D2", 2000.0, 100.0)], "doc_id string, page_no int, idx int, identifier string, x double, y double")
    w = words(spark, ("62,77", 90, 126, 44, 16), ("60,41", 90, 146, 44, 16), ("DN1200", 120, 100, 30, 10))
    assert {r["identifier"]: r["score"] for r in geometry.evidence(w, anchors).collect()} == {"D1": 9, "D2": 0}  # levels, a diameter, a pipe's mark


def plain_clusters(values, tolerance):
    out = []
    for v in sorted(values):
        if out and abs(sum(out[-1]) / len(out[-1]) - v) <= tolerance:
            out[-1].append(v)
        else:
            out.append([v])
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 9))
def test_clusters(spark, groups, tolerance):
    df = spark.createDataFrame([(k, [float(v) for v in g]) for k, g in enumerate(groups)], "k int, v array<double>")
    for r in df.select("k", rows.clusters(F.col("v"), F.lit(float(tolerance))).alias("c")).collect():
        assert [len(c["members"]) for c in r["c"]] == [len(c) for c in plain_clusters(groups[r["k"]], tolerance)]


def test_greedy_matches(spark):
    edges = spark.createDataFrame([("d", 1, 1, 10, 11, 5.0), ("d", 1, 1, 12, 13, 1.0), ("d", 1, 2, 12, 14, 2.0), ("d", 1, 2, 15, 16, 9.0), ("d", 1, 3, 10, 20, 999.0)], "doc_id string, page_no int, anchor long, a long, b long, cost double")
    assert sorted((r["anchor"], r["a"]) for r in rows.greedy_matches(edges, 260.0).collect()) == [(1, 12), (2, 15)]


def test_reading_order_and_repeats(spark):
    w = words(spark, ("b", 50, 101, 10, 10), ("a", 10, 100, 10, 10), ("c", 10, 130, 10, 10))
    assert rows.reading_order(w).first()["text"] == "a b\nc"
    seen = w.unionByName(w.withColumn("idx", F.col("idx") + 10)).withColumns({"confidence": F.lit(50.0), "important": F.lit(False), "key": F.col("text")})
    assert sorted(r["idx"] for r in rows.without_repeats(seen).collect()) == [0, 1, 2]


def test_fallback(spark):
    flags = lambda *t: engines.needs_profile_ocr(pages(spark, *t)).first()["needs_ocr"]
    assert flags("PROFIL PODŁUŻNY KANALIZACJI") and not flags("PROFIL KANALIZACJI KD1 DN200") and not flags("opis techniczny") and not flags("PROFIL KANALIZACJI", "DN 200 PVC")


def test_cache(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"3"))], "doc_id string, content binary")
    body = '{"version": "%s", "pages": [{"number": 1, "text": "t", "items": []}]}'
    known = files.select(F.lit("e").alias("identity"), cache.content_hash(F.col("content")).alias("hash"), F.when(F.col("doc_id") == "a", F.lit(body % 7)).when(F.col("doc_id") == "b", F.lit(body % 6)).otherwise("broken").alias("body"))
    found = cache.lookup(files, known, "e", "7")
    assert {r["doc_id"]: r["document"] is not None for r in found.collect()} == {"a": True, "b": False, "c": False}
    assert sorted(r["doc_id"] for r in cache.misses(found).collect()) == ["b", "c"]
    expected = files.select(F.col("doc_id").alias("name"), F.sha2("content", 256).alias("sha256"))
    models = files.withColumnRenamed("doc_id", "name")
    assert cache.checked(models, expected).count() == 3
    with pytest.raises(Exception, match="model missing or changed: c"):
        cache.checked(models.where("name <> 'c'"), expected).collect()


def test_reading_what_the_cache_has_not(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"22")), ("c", bytearray(b"22")), ("d", bytearray(b"bad"))], "doc_id string, content binary")
    body = '{"version": "7", "pages": [{"number": 1, "text": "known", "items": []}]}'
    known = files.where("doc_id = 'a'").select(F.lit("e").alias("identity"), cache.content_hash(F.col("content")).alias("hash"), F.lit(body).alias("body"))

    def read(content):
        if content == b"bad":
            raise ValueError("no picture")
        return {"version": "7", "pages": [{"number": 1, "text": content.decode(), "items": []}]}

    found = cache.recognised(files, known, "e", "7", read)
    got = {r["doc_id"]: (r["document"]["pages"][0]["text"] if r["document"] else None, r["failure"]) for r in found.collect()}
    assert got == {"a": ("known", None), "b": ("22", None), "c": ("22", None), "d": (None, "ValueError: no picture")}
    fresh = cache.cache_rows(found, "e")
    assert fresh.count() == 2 and cache.misses(cache.lookup(files, known.unionByName(fresh), "e", "7")).count() == 1


def test_tiles_and_kept_words(spark):
    df = spark.createDataFrame([(3000, 1000)], "width int, height int")
    assert sorted((r["tile_x"], r["tile_y"], r["tile_w"], r["tile_h"]) for r in tiles.tiles(df).collect()) == [(0, 0, 1700, 1000), (1300, 0, 1700, 1000)]
    seen = spark.createDataFrame([("KD1", 5.0, 10.0, 10.0, 100.0, 100.0), ("xy", 27.0, 1.0, 1.0, 100.0, 100.0), ("xy", 28.0, 1.0, 1.0, 100.0, 100.0), ("DN200", 90.0, 200.0, 1.0, 100.0, 100.0)], "text string, confidence double, x double, y double, width double, height double")
    assert [r["text"] for r in tiles.kept_words(seen).collect()] == ["KD1", "xy"]


def test_workbook_and_files(spark, tmp_path):
    df = spark.createDataFrame([("D1", 1.5, None), ("D<2>", 2.0, "x")], "id string, h double, note string")
    sinks.write_workbook(str(tmp_path / "a.xlsx"), {"Studnie": df, "Rury": df.limit(0)})
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert z.testzip() is None and "D&lt;2&gt;" in sheet and '<c r="B2"><v>1.5</v></c>' in sheet and 'ref="A1:C3"' in sheet
    assert [sinks.address(c, 1) for c in (1, 26, 27, 702)] == ["A1", "Z1", "AA1", "ZZ1"]
    at = datetime(2024, 5, 6, 7, 8, 9)
    report = spark.createDataFrame([(2, "b"), (1, "a")], "n int, value string")
    path = sinks.write_report(report, str(tmp_path / "r"), "check", at)
    sinks.write_report(report.limit(1), str(tmp_path / "r"), "check", at.replace(day=7))
    assert path.endswith("check_20240506_070809") and [r["value"] for r in spark.read.text(path).collect()] == ["a", "b"] and spark.read.text(str(tmp_path / "r/check_LATEST")).count() == 1
    score = spark.createDataFrame([(15, 14, 13, 12, 11, 0)], "found long, dn long, height long, type long, crown long, extras long")
    for day in (6, 7):
        sinks.append_history(score, str(tmp_path / "h"), "1.0", at.replace(day=day))
    assert [(r["timestamp"], r["id"]) for r in sinks.read_history(spark, str(tmp_path / "h")).collect()] == [("2024-05-06 07:08:09", "15"), ("2024-05-07 07:08:09", "15")]
    assert sum(r["value"] == sinks.HISTORY for r in spark.read.text(str(tmp_path / "h/*")).collect()) == 1


def test_sheets(spark):
    pipes = spark.createDataFrame([("PVC", 200, 1, "a", "x"), ("PE", 100, 1, "a", "y"), ("PE", None, 1, "a", "z")], "material string, diameter_mm int, page int, source_document string, raw_text string")
    assert [r["DN [mm]"] for r in sinks.pipe_sheet(pipes).collect()] == [None, 100, 200] and tuple(sinks.pipe_sheet(pipes).columns) == sinks.PIPES
    inlets = spark.createDataFrame([("WP12", "niska", ["a", "b"]), ("WP2", "niska", ["a"])], "identifier string, confidence string, source_documents array<string>")
    assert [tuple(r) for r in sinks.inlet_sheet(inlets).collect()] == [("WP2", "niska", "a"), ("WP12", "niska", "a | b")]


def test_a_document_that_no_engine_read(spark):
    ranks = spark.createDataFrame([("vector", 0)], "engine string, engine_rank int")
    docs = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    with pytest.raises(Exception, match="no engine read document e"):
        engines.chosen_engine(pages(spark, "D1", engine="vector"), ranks, docs).collect()


def test_words_of_characters(spark):
    def page(name, gap, blank):
        out, x = [], 0
        for k, c in enumerate("AB CD EF"):
            if c != " " or blank:
                out.append((name, 1, k, c, x, 100 + k % 2, x + 5, 110 + k % 2))
            x += 6 if c != " " else gap
        return out

    glyphs = spark.createDataFrame(page("blanks", 6, True) + page("gaps", 9, False) + page("tight", 0, False), "doc_id string, page_no int, idx int, char string, left int, top int, right int, bottom int")
    found = {}
    for r in rows.page_words(glyphs).orderBy("idx").collect():
        found.setdefault(r["doc_id"], []).append(r["text"])
    assert found == {"blanks": ["AB", "CD", "EF"], "gaps": ["AB", "CD", "EF"], "tight": ["ABCDEF"]}


def test_streamed_pages(spark, tmp_path):
    from plansift.streaming import watch

    pages(spark, "D1 studnia", "PZT KD2").write.parquet(str(tmp_path / "in"))
    q = watch.write_identifiers(watch.pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r["identifier"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["D1", "KD2"]
