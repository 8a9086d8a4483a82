import html
import itertools
import re

import numpy as np
import pytest

from plansift.llm import html_extract as H
from plansift.llm.html_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return H.default_model()


def test_messages_give_exact_marginals():
    pages = [H.Page(h) for h in ("<div class=ad><p>a b<p>c</div><p>d", "", "x<ul><li><a href=/>l</a><li>m</ul>")]
    rng = np.random.default_rng(0)
    model = H.Model(rng.normal(0, 1, H.FEATURES), rng.normal(0, 1, (2, 2, 2)))
    p, pairs = model.marginals(forest := H.Forest(pages))
    for page, first in zip(pages, forest.first, strict=False):
        n = len(page.parent)
        unary = [sum(model.weights[k] for k in f) for f in page.features]
        total, on = 0.0, np.zeros(n)
        both = np.zeros((n, 2, 2))
        for s in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(unary[k] for k in range(n) if s[k]) + sum(model.edges[int(page.texts[k] is not None), s[page.parent[k]], s[k]] for k in range(1, n)))
            total += w
            on += w * np.array(s)
            for k in range(1, n):
                both[k, s[page.parent[k]], s[k]] += w
        assert np.allclose(p[first : first + n], on / total)
        assert np.allclose(pairs[first + 1 : first + n], both[1:] / total)


def test_held_out_pages(model):
    pages = labelled_pages(200, seed=77)
    found = H.texts([a for a, _ in pages], model)
    lines = lambda t: set(t.split("\n")) - {""}
    both = sum(len(lines(f) & lines(w)) for f, (_, w) in zip(found, pages, strict=True))
    assert both / sum(len(lines(w)) for _, w in pages) > 0.97
    assert both / sum(len(lines(f)) for f in found) > 0.97


def test_the_articles_of_the_pages_table(spark, sf_dir, model):
    from plansift.llm.queries import op1_html_text

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = op1_html_text(spark, sf_dir).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.sub("<!--.*?-->", "", re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]]["html"], re.S)[1], flags=re.S)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>|<br>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


STORY = "<h1>A walk by the river</h1><p>We left early, and the town was still asleep.</p><p>By noon the path had turned to sand.</p>"
TOLD = "A walk by the river\nWe left early, and the town was still asleep.\nBy noon the path had turned to sand."
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li><li><a href=/c>Shop</a></li></ul>"


@pytest.mark.parametrize(
    "page,want",
    [  # written by hand, not by the maker of the training pages
        ("Only words, and not a tag in sight. They make a short text all the same.", "Only words, and not a tag in sight. They make a short text all the same."),
        (STORY, TOLD),
        (f"<body><nav>{MENU}</nav><main>{STORY}<p class=newsletter>Get our letter every week.</p></main><footer>&copy; 2020 Someone</footer>", TOLD),
        (f"<body><table><tr><td><a href=/>Home</a></td><td><a href=/n>News</a></td><td><a href=/k>Contact</a></td></tr></table><main>{STORY}</main><footer>&copy; Someone</footer>", TOLD),
        (f"<body><div class=header><a href=/>Logo</a></div><div id=content>{STORY}</div><div id=sidebar>{MENU}</div><div class=footer>All rights reserved.</div>", TOLD),
        (f"<body><main>{STORY}<section id=comments><h3>2 comments</h3><div class=comment><p>Nice story, thank you.</p></div></section></main>", TOLD),
        (f"<body><article>{STORY}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be it.</p></article>", TOLD + "\nLet x=2 be it."),
        (f"<body><div class=cookie-banner><p>We use cookies on this site.</p><button>OK</button></div><article>{STORY}</article><aside><p>Read next</p></aside>", TOLD),
    ],
)
def test_pages_of_other_kinds(model, page, want):
    assert H.texts([page], model) == [want]


def test_odd_pages(spark, model):
    art = lambda t: f"<body><nav><ul><li><a href=/a>Menu</a></ul></nav><article><h1>Head line</h1>{t}</article><footer>&copy; us</footer>"
    long = "<p>" + "One two three, four five. " * 20_000
    rows = [
        (1, "u", None, ""),
        (2, "u", "", ""),
        (3, None, art("<p>A &amp; B&nbsp;&eacute; &#x41;&lt;i&gt;.\n  Next   line.<p>Second <b>bold</b>face <a href='x>y'>link</a> here."), "Head line\nA & B é A<i>. Next line.\nSecond boldface link here."),
        (4, "u", art("<script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no --><p>Yes, it is shown here."), "Head line\nYes, it is shown here."),
        (5, "u", art("<p>Ends in an open comment, all of it.<!-- cut off"), "Head line\nEnds in an open comment, all of it."),
        (6, "u", art("<p>An unclosed quote <b class=\"x>does not stop it.</b>"), None),
        (7, "u", art(long), "Head line\n" + " ".join(long[3:].split())),
        (8, "u", "<div>" * 3000 + art("<p>Deep down it is, as it seems.") + "</div>" * 10, "Head line\nDeep down it is, as it seems."),
        (3, "again", art("<p>A row that comes again, with the id."), "Head line\nA row that comes again, with the id."),
        (9, "u", "<" * 5000 + "a <b" * 3000, None),
    ]
    df = spark.createDataFrame([(i, u, h, 0, "c") for i, u, h, _ in rows], "page_id long, url string, html string, text int, n_chars string")
    found = {(r["page_id"], r["url"]): r["text"] for r in H.extract(df, model).collect()}
    assert len(found) == len(rows)
    for i, u, _, want in rows:
        assert found[i, u] is not None and want in (None, found[i, u]), i
    assert H.extract(df.limit(0), model).collect() == []
