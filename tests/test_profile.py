"""Nodes of longitudinal profiles from word boxes, with the results known. All pages go through one run."""

import pytest

from plansift import model
from plansift.operators import geometry, profile


def row(texts, x, y, step=100, w=28, h=10):
    return [(t, x + step * k, y, w, h) for k, t in enumerate(texts)]


D14 = row(["D1", "D2", "D3", "D4"], 95, 500, w=10)
ODD = [23, 66, 68, 45, 21, 90, 7, 55, 31, 78, 12, 99, 41, 3, 60, 84, 17, 36]
BARE = row([str(k) for k in range(8, 13)], 100, 500, w=10)
PAGES = {
    "distractors": ("PROFIL", row(["D1", "D2", "D3"], 95, 500, w=10) + row(["64,20", "64,10", "64,00"], 90, 320) + row(["62,20", "62,60", "62,80"], 90, 270) + [("63,90", 96, 455, 28, 10), ("60,00", 202, 450, 28, 10)]),
    "depths": ("PROFIL", row(["KD1", "KD2", "KD3", "KD4"], 95, 500, w=10) + row(["64,20", "64,10", "64,00", "63,90"], 90, 320) + row(["62,20", "62,60", "62,80", "62,00"], 90, 270) + row(["2,00", "1,50", "1,20", "1,90"], 90, 200) + row(["DN1200"] * 4, 90, 150)),
    "storm": ("profil kanalizacji deszczowej", BARE + row(["64,20", "64,10", "64,00", "63,90", "63,80"], 100, 400) + row(["62,20", "62,10", "62,00", "61,90", "61,80"], 100, 350)),
    "sanitary": ("KANALIZACJI SANITARNEJ", BARE),
    "odd": ("KANALIZACJI DESZCZOWEJ", row([str(k) for k in ODD], 100, 500, w=10)),
    "noise": ("PROFIL", D14 + row(["64,20", "64,10", "64,00", "63,90"], 90, 400) + row(["62,20", "62,10", "62,00", "61,90"], 90, 350) + row(["DN1200"] * 4, 90, 250) + row(["S79", "S13", "S33", "S61", "S45", "S52"], 1200, 800, step=20, w=10)),
    "marker": ("PROFIL", row(["KDist", "KD1", "KD2", "KD3", "S9"], 95, 500, w=10) + row(["D4", "D5", "D6", "D7", "D8"], 95, 700, w=10)),
    "metres": ("PROFIL", row(["D1", "D2", "D3"], 95, 500, w=10) + [("1,2m", 95, 700, 10, 10), ("1,5", 195, 720, 10, 10), ("1,2", 95, 820, 10, 10)]),
}


@pytest.fixture(scope="module")
def nodes(spark):
    boxes = [(name, 1, k, t, float(x), float(y), float(w), float(h)) for name, (_, page) in PAGES.items() for k, (t, x, y, w, h) in enumerate(page)]
    words = spark.createDataFrame(boxes, model.WORDS)
    texts = spark.createDataFrame([(name, 1, t) for name, (t, _) in PAGES.items()], "doc_id string, page_no int, text string")
    out = {name: {} for name in PAGES}
    for r in profile.profile_nodes(geometry.exact_labels(words, profile=True), words, texts).collect():
        out[r["doc_id"]][r["identifier"]] = r
    return out


def test_bands_with_distractors(nodes):
    found = nodes["distractors"]
    assert {k: r["height_m"] for k, r in found.items()} == {"D1": 2.0, "D2": 1.5, "D3": 1.2}
    assert (found["D1"]["ground_m"], found["D1"]["invert_m"]) == (64.2, 62.2)


def test_a_depth_row_gives_heights_alone(nodes):
    found = nodes["depths"]
    assert {k: (r["height_m"], r["ground_m"], r["diameter_mm"], r["evidence"]) for k, r in found.items()} == {k: (pytest.approx(h - 0.15), None, 1200, 4) for k, h in {"KD1": 2.0, "KD2": 1.5, "KD3": 1.2, "KD4": 1.9}.items()}


def test_lost_letters(nodes):
    assert set(nodes["storm"]) == {f"D{k}" for k in range(8, 13)}
    assert all(r["height_m"] == 2.0 for r in nodes["storm"].values())


def test_a_long_run_without_elevations(nodes):
    assert set(nodes["sanitary"]) == {f"S{k}" for k in range(8, 13)}


def test_irregular_numbers_are_no_nodes(nodes):
    assert nodes["odd"] == {}


def test_a_denser_row_of_noise(nodes):
    assert {k: r["diameter_mm"] for k, r in nodes["noise"].items()} == dict.fromkeys(["D1", "D2", "D3", "D4"], 1200)


def test_the_marker_of_the_existing_sewer(nodes):
    assert set(nodes["marker"]) == {"KDIST", "KD1", "KD2", "KD3"}


def test_metres_in_a_column(nodes):
    assert {k: r["diameter_mm"] for k, r in nodes["metres"].items()} == {"D1": 1200, "D2": 1500, "D3": None}
