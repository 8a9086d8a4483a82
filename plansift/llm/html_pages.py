"""Labelled pages for training the HTML extractor: made by rule, in many layouts, with the wanted text of each."""

from __future__ import annotations

import html
import random

SYLLABLES = ["ba en ti or la su ke mo ri da the ing er on st".split(), "ö ch ung sch ein be ver ß keit au".split(), "é que eau tion è aux oi la de".split(), "ña rr ción os ar ll que mi".split(), "по на ва ри ко те но ло".split(), "山 水 日 本 人 文 大".split()]


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.syllables = self.rng.choice(SYLLABLES)
        self.out: list[str] = []
        self.wanted: list[str] = []

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.randrange(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(max(1, n)))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.rng.randrange(1, 14)).capitalize() + self.rng.choice(["."] * 8 + ["?", "!"]) for _ in range(n))

    def odd(self) -> str:
        """Text as poor pages have it: what it says doesn't make it part of the page's frame."""
        kind, n = self.rng.randrange(5), self.rng.randrange(3, 60)
        if kind == 0:
            return " | ".join(self.words(1) for _ in range(n))
        if kind == 1:
            return " ".join(self.word().upper() + "!!" for _ in range(n))
        if kind == 2:
            return " ".join(self.word() + self.rng.choice(["###", "$$$", "%%%", "&&&", "***"]) for _ in range(n))
        if kind == 3:
            return " ".join([self.word() + self.rng.choice(["", ",", "."])] * n)
        return self.rng.choice(["", f"{self.rng.randrange(99)} ", "© "]) + self.words(self.rng.randrange(1, 4))

    def put(self, tag: str, attrs: str = "") -> None:
        self.out.append(f"<{tag}{' ' + attrs if attrs else ''}>")

    def text(self, value: str, wanted: bool) -> None:
        self.out.append(html.escape(value, quote=False))
        if wanted:
            self.wanted.append(value)

    def element(self, tag: str, value: str, wanted: bool, attrs: str = "", close: bool = True) -> None:
        self.put(tag, attrs)
        self.text(value, wanted)
        if close:
            self.out.append(f"</{tag}>")

    def named(self, *names: str) -> str:
        name = self.rng.choice(names)
        if self.rng.random() < 0.4:
            name = f"{self.rng.choice(['site', 'page', 'my', 'js', 'c', 'top', 'main', 'wp'])}-{name}"
        return f'{self.rng.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int, wrap: str = "li") -> None:
        for _ in range(n):
            self.out.append(f'<{wrap}><a href="/{self.word()}">' if wrap else f'<a href="/{self.word()}">')
            self.text(self.words(self.rng.randrange(1, 4)), False)
            self.out.append(f"</a></{wrap}>" if wrap else "</a> ")

    def boxed(self, tag: str, attrs: str, body) -> None:
        self.put(tag, attrs)
        body()
        self.out.append(f"</{tag}>")

    def paragraph(self, wanted: bool) -> None:
        if self.rng.random() < 0.2:
            start, link, rest = self.sentences(1), self.words(2), self.sentences(self.rng.randrange(1, 4))
            self.out.append(f'<p>{html.escape(start, quote=False)} <a href="/x">{html.escape(link, quote=False)}</a> {html.escape(rest, quote=False)}</p>')
            if wanted:
                self.wanted.append(f"{start} {link} {rest}")
        elif self.rng.random() < 0.1:
            self.element("p", self.odd(), wanted, close=self.rng.random() < 0.9)
        elif self.rng.random() < 0.15:
            self.out.append("<p><b>")
            self.text(self.sentences(2), wanted)
            self.out.append("<br>")
        else:
            self.element("p", self.sentences(self.rng.randrange(1, 8)) if self.rng.random() < 0.8 else self.words(self.rng.randrange(1, 5)), wanted, close=self.rng.random() < 0.9)

    def noise(self) -> None:
        kind, rng = self.rng.randrange(17), self.rng
        if kind == 14:
            self.element("p", self.sentences(rng.randrange(1, 3)), False, self.named("newsletter", "subscribe", "signup", "notice", "ad", "sponsored", "share", "cookies", "login"))
        elif kind == 15:
            self.boxed("p", "", lambda: self.links(rng.randrange(3, 7), ""))
        elif kind == 16:
            self.boxed("table", rng.choice(["", self.named("menu", "nav")]), self.menu_rows)
        elif kind == 0:
            self.boxed("div", self.named("ad", "ads", "advert", "banner", "sponsored", "promo"), lambda: self.text(self.sentences(rng.randrange(1, 4)), False))
        elif kind == 1:
            self.boxed(rng.choice(["aside", "div"]), self.named("sidebar", "widget", "side"), lambda: (self.element("h3", self.words(2), False), self.put("ul"), self.links(5), self.out.append("</ul>"), self.element("p", self.sentences(1), False)))
        elif kind == 2:
            self.boxed("aside", "", lambda: [self.element("p", self.sentences(2), False) for _ in range(rng.randrange(1, 4))])
        elif kind == 3:
            self.boxed("div", self.named("cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup"), lambda: (self.element("p", self.sentences(rng.randrange(1, 4)), False), self.element("button", self.word(), False)))
        elif kind == 4:
            self.boxed("form", 'action="/send"', lambda: (self.element("label", self.words(2), False), self.out.append('<input type="text" name="q">'), self.element("p", self.sentences(1), False), self.element("button", self.word(), False)))
        elif kind == 5:
            self.boxed("div", self.named("newsletter", "subscribe", "signup", "login"), lambda: (self.element("h4", self.words(3), False), self.element("p", self.sentences(2), False)))
        elif kind == 6:
            self.boxed("div", self.named("related", "recommended", "more", "popular"), lambda: (self.element("h3", self.words(2), False), self.put("ul"), self.links(4), self.out.append("</ul>")))
        elif kind == 7:
            self.boxed("div", self.named("share", "social", "tags", "breadcrumb", "breadcrumbs"), lambda: self.links(rng.randrange(2, 5), rng.choice(["", "span"])))
        elif kind == 8:
            self.boxed("nav", rng.choice(["", self.named("nav", "menu", "pagination")]), lambda: (self.put("ul"), self.links(rng.randrange(2, 8)), self.out.append("</ul>")))
        elif kind == 9:
            self.boxed("div", self.named("menu", "navbar", "toolbar"), lambda: self.links(rng.randrange(2, 8), rng.choice(["", "span", "li"])))
        elif kind == 10:
            self.boxed(rng.choice(["section", "div", "ol"]), self.named("comments", "comment-list", "replies", "respond", "discussion"), self.comments)
        elif kind == 11:
            self.boxed("div", 'role="' + rng.choice(["complementary", "banner", "alert", "navigation", "search", "contentinfo"]) + '"', lambda: self.element("p", self.sentences(2), False))
        elif kind == 12:
            self.out.append(f"<script>var x = '<p>{self.words(5)}</p>';</script>")
        else:
            self.out.append(f"<!-- {self.word()} {rng.randrange(99)} -->")

    def menu_rows(self) -> None:
        rows = self.rng.choice([1, 1, 4])
        for _ in range(rows):
            self.put("tr")
            self.links(self.rng.randrange(2, 6) if rows == 1 else 1, "td")
            self.out.append("</tr>")

    def formula(self) -> None:
        """A paragraph with a formula in it."""
        parts = [self.sentences(1), "x", "=", self.word(), self.sentences(1)]
        self.out.append(f"<p>{html.escape(parts[0], quote=False)} <math><mi>x</mi><mo>=</mo><mi>{parts[3]}</mi></math> {html.escape(parts[4], quote=False)}</p>")
        self.wanted.append(f"{parts[0]} x={parts[3]} {parts[4]}")

    def comments(self) -> None:
        if self.rng.random() < 0.5:
            self.element("h3", self.words(2), False)
        for _ in range(self.rng.randrange(1, 5)):
            self.boxed(self.rng.choice(["div", "li", "article"]), self.named("comment", "reply"), lambda: (self.element("span", self.word(), False, 'class="author"'), [self.element("p", self.sentences(self.rng.randrange(1, 6)), False) for _ in range(self.rng.randrange(1, 3))]))

    def story(self, inner: bool) -> None:
        rng = self.rng
        if rng.random() < 0.85:
            title = self.words(rng.randrange(1, 9)).capitalize()
            if rng.random() < 0.2:
                self.boxed("header", "", lambda: self.element("h1", title, True))
            else:
                self.element(rng.choice(["h1", "h1", "h2"]), title, True)
            if rng.random() < 0.2:  # a short notice, headline and first words alike
                self.out.append("<p><b>")
                self.text(title, True)
                self.out.append("<br>")
                return
        for _ in range(rng.choice([1, 1, 1, 2, 3, 4, 6, 9, 14])):
            kind = rng.random()
            if kind < 0.72:
                self.paragraph(True)
            elif kind < 0.78:
                self.element(rng.choice(["h2", "h3"]), self.words(rng.randrange(1, 6)).capitalize(), True)
            elif kind < 0.83:
                self.put(tag := rng.choice(["ul", "ol"]))
                for _ in range(rng.randrange(2, 5)):
                    self.element("li", self.sentences(1) if rng.random() < 0.7 else self.words(2), True)
                self.out.append(f"</{tag}>")
            elif kind < 0.86:
                self.boxed("blockquote", "", lambda: self.paragraph(True))
            elif kind < 0.89:
                self.put("table")
                for _ in range(2):
                    self.put("tr")
                    for _ in range(3):
                        self.element("td", self.words(rng.randrange(1, 3)), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif kind < 0.92:
                self.boxed("figure", "", lambda: (self.out.append('<img src="/i.png" alt="x">'), self.element("figcaption", self.sentences(1), True)))
            elif kind < 0.95:
                self.boxed("div", "", lambda: self.paragraph(True))
            elif inner and kind < 0.985:
                self.noise()
            else:
                self.formula()

    def bare(self) -> tuple[str, str]:
        """A page of text alone, or of blocks without any frame."""
        kind, rng = self.rng.randrange(3), self.rng
        if kind == 0:
            self.text(self.sentences(rng.randrange(1, 12)), True)
        elif kind == 1:
            self.out.append(rng.choice(["", "<html><body>", "<body>"]))
            for _ in range(rng.randrange(1, 6)):
                self.paragraph(True)
                if self.out[-1] == "<br>":
                    self.out.append("</b></p>")
        else:
            self.out.append(rng.choice(["<div>", "<div><div>", "<center>"]))
            self.story(False)
        return "".join(self.out), "\n".join(" ".join(w.split()) for w in self.wanted)

    def in_table(self) -> tuple[str, str]:
        """A page laid out by a table: a cell of links or boxes beside the cell of the article."""
        rng = self.rng
        self.out.append(f"<html><head><title>{self.words(3)}</title></head><body><table width=100%>")
        if rng.random() < 0.6:
            self.boxed("tr", "", lambda: self.boxed("td", rng.choice(["", "colspan=2", self.named("header", "masthead")]), lambda: self.links(rng.randrange(2, 7), "")))
        self.put("tr")
        sides = [False, True] if rng.random() < 0.7 else [True, False]
        for article in sides:
            self.put("td", rng.choice(["", "valign=top"]) if article else rng.choice(["", "width=150", self.named("menu", "sidebar", "nav")]))
            if article:
                self.story(rng.random() < 0.5)
            elif rng.random() < 0.6:
                self.links(rng.randrange(3, 9), rng.choice(["", "li", "div", "p"]))
            else:
                self.noise()
            self.out.append("</td>")
        self.out.append("</tr>")
        if rng.random() < 0.6:
            self.boxed("tr", "", lambda: self.boxed("td", rng.choice(["colspan=2", self.named("footer", "copyright")]), lambda: (self.out.append("&copy; "), self.text(self.words(3), False))))
        self.out.append("</table></body></html>")
        return "".join(self.out), "\n".join(" ".join(w.split()) for w in self.wanted)

    def page(self) -> tuple[str, str]:
        rng = self.rng
        if (layout := rng.random()) < 0.14:
            return self.bare() if layout < 0.07 else self.in_table()
        self.out.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.words(4)}</title><style>p{{margin:0}}</style></head><body>")
        if rng.random() < 0.7:
            self.boxed(rng.choice(["header", "div"]), self.named("header", "masthead"), lambda: (self.element(rng.choice(["h1", "div", "p"]), self.words(2), False), self.noise()))
        for _ in range(rng.randrange(0, 3)):
            self.noise()
        wrap = rng.choice(["", "", 'div class="wrapper"', 'div id="page"', "main", 'div class="container"'])
        if wrap:
            self.out.append(f"<{wrap}>")
        for _ in range(rng.randrange(0, 2)):
            self.noise()
        tag, attrs = rng.choice([("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", self.named("content", "article", "post", "entry", "story", "text")), ("section", self.named("content", "article")), ("div", 'role="main"'), ("div", 'itemprop="articleBody"'), ("div", ""), ("main", "")])
        self.boxed(tag, attrs, lambda: self.story(True))
        for _ in range(rng.randrange(0, 3)):
            self.noise()
        if wrap:
            self.out.append(f"</{wrap.split()[0]}>")
        if rng.random() < 0.8:
            self.boxed(rng.choice(["footer", "footer", 'div class="footer"']).split()[0], rng.choice(["", self.named("footer", "copyright")]), lambda: (self.out.append("&copy; "), self.text(f"{self.word()} · {self.sentences(rng.randrange(1, 3))}", False)))
        if rng.random() < 0.8:
            self.out.append("</body></html>")
        return "".join(self.out), "\n".join(" ".join(w.split()) for w in self.wanted)


def labelled_pages(n: int = 800, seed: int = 0) -> list[tuple[str, str]]:
    """n pages and the text wanted from each."""
    return [Maker(seed * 1_000_003 + k).page() for k in range(n)]
