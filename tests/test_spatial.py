"""Whole pages from word boxes to records, with the results known. All pages go through one run."""

import pytest

from plansift import model
from plansift.plans import project
from plansift.sources.engines import detected_types

OCR = "OCR/engine tiled"


def row(texts, x, y, step=100, w=28, h=10):
    return [(t, x + step * k, y, w, h) for k, t in enumerate(texts)]


PLAN, PROFILE = "[[DRAWING:PZT]]", "[[DRAWING:PROFIL]]"
SEWERS = [("KDist", 35, 500, 34, 10), ("KD3", 335, 500, 24, 10)]
for n in range(1, 7):
    x = 100 + (n - 1) * 115
    SEWERS += [(str(n), x, 500, 10, 10), (f"{101 + n},20", x - 8, 390, 34, 10), (f"{100 + n},10", x - 8, 350, 34, 10), ("DN1200", x - 10, 300, 44, 10)]
for n, t in enumerate(["D5", "SO", "S8", "KS45", "S6", "S42", "S0"]):
    x = 760 + 85 * n
    SEWERS += [(t, x, 820, 28, 10), (f"{128 + n},20", x - 5, 710, 34, 10), (f"{127 + n},10", x - 5, 670, 34, 10)] + ([("DN1200", x - 8, 630, 44, 10)] if n < 5 else [])
BRANCH = [("KSist", 463), ("KS1", 502), ("KS2", 885), ("KS3", 1244), ("KS2", 1327), ("KS21", 1366), ("KSe.1", 1366), ("KS3", 1492), ("s31", 1512)]

# name: (engine, text, boxes)
PAGES = {
    "own": ("", "D1 D2 studnia DN1200 PVC DN200 studnia DN1500 PP DN300", [("D1", 100, 500, 12, 10), ("studnia", 80, 470, 35, 10), ("DN1200", 120, 470, 35, 10), ("PVC", 90, 440, 20, 10), ("DN200", 115, 440, 30, 10), ("D2", 500, 500, 12, 10), ("studnia", 480, 470, 35, 10), ("DN1500", 520, 470, 35, 10), ("PP", 490, 440, 15, 10), ("DN300", 510, 440, 30, 10)]),
    "odd_dn": ("", "D5 studnia DN2000 PE DN1013", [("D5", 200, 500, 12, 10), ("studnia", 180, 470, 35, 10), ("DN2000", 220, 470, 35, 10), ("PE", 190, 440, 15, 10), ("DN1013", 210, 440, 35, 10)]),
    "dotted": ("", "Profile podłużne kanalizacji deszczowej RZĘDNE DNA PRZEWODU D1.1 Ø1200 ist. ks200 D1.2 Ø1200 ist. przył. ks160 SO Ø2000", [("D1.1", 100, 500, 20, 10), ("Ø1200", 120, 500, 30, 10), ("134.12", 101, 460, 30, 10), ("132.61", 101, 430, 30, 10), ("ks200", 110, 520, 25, 10), ("D1.2", 250, 500, 20, 10), ("Ø1200", 270, 500, 30, 10), ("ks160", 260, 520, 25, 10), ("SO", 400, 500, 15, 10), ("Ø2000", 420, 500, 30, 10)]),
    "plan": ("", "Plan sytuacyjno - wysokościowy Projekt zagospodarowania terenu D6 133,70 128,94 Ø800", [("D6", 500, 500, 16, 10), ("133,70", 495, 470, 32, 10), ("128,94", 515, 470, 32, 10), ("Ø800", 510, 520, 25, 10)]),
    "split": ("", "Plan sytuacyjno - wysokościowy D6/1 133,55 126,47 D7 133,65 126,51", [("D", 885, 1903, 15, 20), ("6/1", 900, 1901, 20, 14), ("133,55", 860, 1892, 23, 8), ("126,47", 860, 1901, 23, 8), ("D7", 882, 1910, 10, 8), ("133,65", 848, 1934, 23, 8), ("126,51", 848, 1943, 23, 8)]),
    "doubled": ("", "Projekt zagospodarowania terenu", [("DD", 885, 1903, 15, 20), ("66//11", 900, 1901, 20, 14), ("133,55", 860, 1892, 23, 8), ("1", 860, 1901, 4, 8), ("2", 864, 1901, 4, 8), ("6,47", 868, 1901, 15, 8), ("DD", 873, 1944, 15, 20), ("77", 888, 1943, 8, 14), ("133,65", 848, 1934, 23, 8), ("126,51", 848, 1943, 23, 8)]),
    "stream": ("", "Projekt zagospodarowania terenu", [("D", 100, 100, 8, 10), ("20", 109, 100, 12, 10), ("D", 160, 100, 8, 10), ("21", 169, 100, 12, 10), ("D", 220, 100, 8, 10), ("22", 229, 100, 12, 10)]),
    "read": (OCR, "D 7 62,13 60,65 D 8 62,13 60,73", [("D", 100, 100, 12, 18), ("7", 114, 100, 9, 18), ("62,13", 92, 126, 44, 16), ("60,65", 92, 146, 44, 16), ("D8", 300, 100, 24, 18), ("62,13", 292, 126, 44, 16), ("60,73", 292, 146, 44, 16)]),
    "bracket": (OCR, "D2 62,77 60,4]", [("D2", 100, 100, 24, 18), ("62,77", 90, 126, 44, 16), ("60,4]", 90, 146, 44, 16)]),
    "noise": (OCR, "D60 mat= D00 przypadkowe fragmenty", [("opis", 10, 10, 20, 10)]),
    "compact": ("", "PROFIL KANALIZACJI SANITARNEJ KS3 studnia DN1200 PVC160 PVC200", [("KS3", 100, 100, 25, 12), ("studnia", 100, 120, 40, 12), ("DN1200", 145, 120, 45, 12), ("PVC160", 100, 140, 45, 12), ("PVC200", 150, 140, 45, 12)]),
    "zeros": (OCR, "Plan sytuacyjno wysokościowy S08 S95", [("S08", 100, 100, 20, 10), ("62,85", 105, 120, 30, 10), ("61,79", 105, 138, 30, 10), ("S95", 500, 500, 20, 10)]),
    "apart": (OCR, "PROFIL KANALIZACJI D7 PVC 200", [("D7", 100, 100, 20, 10), ("62,13", 100, 125, 35, 10), ("60,65", 100, 145, 35, 10), ("PVC", 120, 165, 25, 10), ("200", 150, 165, 22, 10)]),
    "high": (OCR, "S95", [("S95", 100, 100, 20, 10)]),
    "rows": ("", PROFILE + " RZĘDNE DNA PRZEWODU", row(["D1", "D2", "D3"], 95, 500, w=10) + row(["64,20", "64,10", "64,00"], 90, 320) + row(["62,20", "62,60", "62,80"], 90, 270) + [("63,90", 96, 455, 28, 10), ("60,00", 202, 450, 28, 10)]),
    "dn_row": ("", PROFILE + " PROFIL", row(["D1", "D2", "D3"], 95, 500, w=10) + row(["DN1200"] * 3, 88, 220, w=35) + [("PVC160", 100, 460, 35, 10), ("PVC200", 200, 460, 35, 10)]),
    "geometry": ("", PROFILE + " PROFIL KANALIZACJI RZĘDNE DNA PRZEWODU", row(["D1", "D2", "D3", "D4"], 100, 520, 120, 12) + row(["62,70", "62,64", "62,60", "62,55"], 92, 320, 120) + row(["60,49", "60,43", "61,04", "61,51"], 92, 270, 120) + [("61,13", 103, 487, 28, 10), ("60,95", 223, 482, 28, 10), ("61,79", 343, 478, 28, 10)] + row(["DN1200"] * 4, 88, 215, 120, 40) + [("PVC160", 100, 450, 35, 10), ("PVC200", 220, 450, 35, 10)]),
    "pipes_alone": ("", PROFILE + " PROFIL", row(["D1", "D2", "D3"], 100, 500, 120, 12) + [("PVC160", 95, 440, 35, 10), ("PVC200", 215, 430, 35, 10), ("PP300", 335, 420, 35, 10)]),
    "depths": ("", PROFILE, row(["KD1", "KD2", "KD3", "KD4"], 95, 500, w=10) + row(["64,20", "64,10", "64,00", "63,90"], 90, 320) + row(["62,20", "62,60", "62,80", "62,00"], 90, 270) + row(["2,00", "1,50", "1,20", "1,90"], 90, 200) + row(["DN1200"] * 4, 90, 150)),
    "staggered": (OCR, PROFILE + " PROFIL KANALIZACJI SANITARNEJ RZĘDNE DNA PRZEWODU", [("S1", 100, 710, 18, 10), ("S2", 250, 728, 18, 10), ("S3", 400, 746, 18, 10), *row(["135,40", "135,25", "135,10"], 92, 420, 150, 42), *row(["134,20", "133,95", "133,70"], 92, 370, 150, 42), ("S20", 900, 90, 24, 12), ("NR RYS.", 850, 90, 45, 12)]),
    "sewers": (OCR, PROFILE + " PROFIL KANALIZACJI DESZCZOWEJ RZĘDNE DNA PRZEWODU", SEWERS),
    "lines": (OCR, PROFILE + "\nPVC DN200\nPVC DN250\nPVC DN300\nPE D500\nDN600\nPE DN1200\nPVC DN2\nPVC d=128\nPE d=107\nPVC29\nPE054", [("KD1", 100, 500, 24, 10), ("KD2", 300, 500, 24, 10), ("DN1200", 100, 300, 40, 10), ("DNi200", 300, 300, 40, 10)]),
    "large": (OCR, PROFILE + " PE DN1200", [("DN1200", 100, 100, 40, 10), ("DN1200", 1000, 800, 40, 10)]),
    "rare": (OCR, PROFILE + " PE DN355", []),
    "kds": ("vector", PLAN, [("KDS", 100, 100, 24, 10)]),
    "twice": (OCR, PROFILE + " KDist D7 D7", [("KDist", 100, 100, 34, 10)]),
    "branches": (OCR, PROFILE + " PROFIL KANALIZACJI SANITARNEJ SO SO", [(t, x, 1134, 24, 10) for t, x in BRANCH] + [("SO", 2083, 1040, 12, 27)]),
    "kin": (OCR, PROFILE + " KANALIZACJA DESZCZOWA KD4 KD4 SO SO", [("KD1", 100, 500, 24, 10), ("KD2", 250, 500, 24, 10), ("KD3", 400, 500, 24, 10)]),
    "strict": ("vector/strict", PROFILE + " KANALIZACJA DESZCZOWA S2 S2 D8 D8", [(f"KD{n}", n * 100, 500, 24, 10) for n in range(1, 11)]),
    "inlets": ("", "Plan D1", [("WP3", 10, 10, 20, 10), ("W4", 50, 10, 20, 10), ("w5", 90, 10, 20, 10)]),
    "text": ("", "D5 Studnia kinetowa DN2000 wys. całk. 4,50 m zwieńczenie właz żeliwny PVC DN200 PVC DN200 PP DN300", []),
    "cover": ("", PROFILE + "\nPVC-U_SDR34_l\n200×5,9\nPVC-U_SDR34_l\n250×7,3\nwłaz klasa D 400\nD400", []),
    "cover_plan": ("", PLAN + "\nwłaz klasa D 400\nDN 400", []),
    "concrete": ("", PROFILE + "\nD 300 betonowe typu „WIPRO”\nD400\nbetonowe typu WIPRO\nwłaz klasa D 400", []),
}


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame([(name, 1, t, None, None, e) for name, (e, t, _) in PAGES.items()], model.PAGES)
    words = spark.createDataFrame([(name, 1, k, t, float(x), float(y), float(w), float(h)) for name, (_, _, boxes) in PAGES.items() for k, (t, x, y, w, h) in enumerate(boxes)], model.WORDS)
    types = detected_types(pages)
    found = {name: {} for name in PAGES}
    for r in project.page_records(pages, types, words).collect():
        assert r["identifier"] not in found[r["doc_id"]]
        found[r["doc_id"]][r["identifier"]] = r
    pipes = {name: [] for name in PAGES}
    for r in project.page_pipes(pages, types, words).collect():
        pipes[r["doc_id"]].append(((r["material"] or "").upper(), r["diameter_mm"]))
    inlets = sorted((r["identifier"], r["confidence"]) for r in project.page_inlets(pages, words).where("doc_id = 'inlets'").collect())
    return found, pipes, inlets


@pytest.fixture(scope="module")
def found(tables):
    return tables[0]


def moved(r):
    return {(t["material"], t["diameter_mm"]): t["quantity"] for t in r["transitions"]}


def heights(rows):
    return {k: r["height_m"] for k, r in rows.items()}


def test_each_keeps_what_is_its_own(found):
    a, b = found["own"]["D1"], found["own"]["D2"]
    assert (a["diameter_mm"], b["diameter_mm"]) == (1200, 1500)
    assert ("PVC", 200) in moved(a) and ("PP", 300) not in moved(a) and ("PP", 300) in moved(b)


def test_a_pipes_diameter_is_no_manholes(found):
    assert found["odd_dn"]["D5"]["diameter_mm"] == 2000
    assert [r["diameter_mm"] for r in found["pipes_alone"].values()] == [None] * 3


def test_dotted_names_and_pipe_labels(found):
    assert {k: r["diameter_mm"] for k, r in found["dotted"].items()} == {"D1.1": 1200, "D1.2": 1200, "SO": 2000}
    assert found["dotted"]["D1.1"]["height_m"] == 1.51


def test_levels_on_plans(found):
    r = found["plan"]["D6"]
    assert (r["height_m"], r["diameter_mm"], r["confidence"]) == (4.76, None, "średnia")
    for page in ("split", "doubled"):
        assert heights(found[page]) == {"D6/1": 7.08, "D7": 7.14}, page
    assert (found["split"]["D6/1"]["ground_m"], found["split"]["D7"]["invert_m"]) == (133.55, 126.51)
    assert {"D20", "D21", "D22"} <= set(found["stream"])  # and D2, as 22 beside a D reads as doubled glyphs too


def test_what_ocr_read(found):
    assert heights(found["read"]) == {"D7": 1.48, "D8": 1.4} and found["read"]["D7"]["ground_m"] == 62.13
    assert (found["bracket"]["D2"]["invert_m"], found["bracket"]["D2"]["height_m"]) == (60.41, 2.36)
    assert found["noise"] == {} and set(found["zeros"]) == {"S8"}
    assert found["apart"]["D7"]["height_m"] == 1.48 and ("PVC", 200) in moved(found["apart"]["D7"])
    assert found["high"]["S95"]["confidence"] == "niska" and "weryfikacji" in found["high"]["S95"]["validation_issues"]
    assert "KD5" not in found["kds"]


def test_transitions_in_one_word(found):
    assert {("PVC", 160), ("PVC", 200)} <= set(moved(found["compact"]["KS3"]))


def test_rows_of_profiles(found):
    assert heights(found["rows"]) == {"D1": 2.0, "D2": 1.5, "D3": 1.2}
    assert {r["diameter_mm"] for r in found["dn_row"].values()} == {1200}
    assert heights(found["geometry"]) == {"D1": 2.21, "D2": 2.21, "D3": 1.56, "D4": 1.04} and {r["diameter_mm"] for r in found["geometry"].values()} == {1200}
    assert heights(found["staggered"]) == {"S1": 1.2, "S2": 1.3, "S3": 1.4}


def test_depths_tell_type_and_crown_and_hide_levels(found):
    rows = found["depths"]
    assert heights(rows) == {"KD1": 1.85, "KD2": 1.35, "KD3": 1.05, "KD4": 1.75}
    assert {r["type"] for r in rows.values()} == {"kinetowa"} and {r["ground_m"] for r in rows.values()} == {None}
    assert [rows[k]["crown"] for k in ("KD1", "KD3")] == ["zwężka", "pierścień+płyta_odc."]


def test_nodes_whose_letters_were_lost(found):
    assert set(found["sewers"]) == {"KDIST", *(f"KD{n}" for n in range(1, 7))}


def test_names_in_text_alone(found):
    assert "D7" in found["twice"] and "KD4" in found["kin"] and "SO" not in found["kin"]
    assert set(found["strict"]) == {f"KD{n}" for n in range(1, 11)}


def test_misread_branches(found):
    assert {"KS1", "KS2", "KS2.1", "KS3", "KS3.1"} <= set(found["branches"]) and not {"KS21", "S31", "SO"} & set(found["branches"])


def test_pages_without_boxes(found):
    r = found["text"]["D5"]
    assert (r["diameter_mm"], r["height_m"], r["type"]) == (2000, 4.5, "kinetowa") and r["crown"].startswith("zwieńczenie")
    assert moved(r) == {("PVC", 200): 2, ("PP", 300): 1}


def test_pipes(tables):
    pipes = tables[1]
    assert sorted(pipes["lines"]) == [("PE", 500), ("PVC", 200), ("PVC", 250), ("PVC", 300)]
    assert ("PE", 1200) in pipes["large"] and ("PE", 355) in pipes["rare"]
    assert {("PVC", 200), ("PVC", 250)} <= set(pipes["cover"]) and not [p for p in pipes["cover"] if p[1] == 400]
    assert [p for p in pipes["cover_plan"] if p[1] == 400]
    assert {("BETON", 300), ("BETON", 400)} <= set(pipes["concrete"])


def test_inlets(tables):
    assert tables[2] == [("WP3", "wysoka"), ("WP4", "wysoka")]
