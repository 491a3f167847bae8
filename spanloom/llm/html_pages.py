"""Labelled web pages to train the extractor on: invented pages of many layouts, each block with its label."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

#: Pages, seed, and the share of pages without speaking elements.
PAGES, SEED, SILENT = 1000, 5, 0.25

# Words that furniture of pages tends to hold.
CUES = frozenset(
    """about accept account ad advert advertisement advertising agree archive author back browse by cart categories click
    close comment comments contact continue cookie cookies copyright disclaimer download email facebook follow help home
    impressum instagram join language latest legal like links loading log login logout mail menu more navigation newer
    newsletter next older ok password policy popular post posted previous print privacy published read register related
    reply reserved rights search send share sign site sitemap skip sponsored submit subscribe tags terms topics trending
    tweet twitter up updated username view website youtube""".split()
)

# Beginnings of the names of furniture.
STEMS = ("comment", "foot", "head", "menu", "nav", "side", "share", "social", "widget", "cookie", "ad", "promo", "disqus", "breadcrumb", "relat")

# Tags and names under which pages keep their main text and their furniture.
MAIN = [
    "article", "article", "article", "main", "main", "section", "div class=post", "div class='entry-content'", "div class=article-body",
    "div id=content", "div class=content", "div class=story", "div class='post-content'", "div id='main-content'", "div class=text",
    "div class=blog-post", "div class=article", "div role=main", "div class=body", "section class=entry", "div",
]
WRAPS = ["div class=wrapper", "div id=page", "div class=container", "div class=row", "div class=layout", "div class=site", "div", "section", "div class=col", "main", "div id=wrapper"]
NAV = ["nav", "nav", "div class=nav", "div id=menu", "ul class=menu", "div class=navbar", "div class=breadcrumb", "nav class=breadcrumbs", "div class=pagination", "div role=navigation", "div class=toc", "div class=topbar", "menu"]
HEADER = ["header", "header", "div class=header", "div id=header", "div class=masthead", "div class=banner", "div id=top", "div class=branding"]
FOOTER = ["footer", "footer", "div class=footer", "div id=footer", "div class=copyright", "div class=legal", "div class=colophon", "div class=bottom"]
SIDE = ["aside", "aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=related", "div class=recommended", "div class=popular", "div class='side-bar right'", "section class=related", "div class=teaser", "div role=complementary"]
ADS = ["div class=ad", "div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=sponsored", "div class=promo", "div id=ad", "aside class=ad", "div class='ad-slot'", "section class=promotion"]
NOTICE = ["div class=cookie", "div class='cookie-banner'", "div class=notice", "div class=consent", "div id=gdpr", "div class=alert", "div class=newsletter", "div class=popup", "div class=modal", "div role=alert", "dialog", "div class=message", "div class=paywall", "section class=notice"]
FORMS = ["form", "form", "form class=search", "form id=login", "form class=subscribe", "div class=signup", "div class='search-box'", "fieldset"]
COMMENTS = ["div class=comments", "section class=comments", "div id=comments", "div class=comment", "section id=comments", "div class=discussion", "div class=replies", "div id=disqus", "ol class=commentlist", "div class=respond", "div id=disqus_thread", "ol class=comment-list", "ul class=commentlist", "div class=reviews", "div class=feedback"]
SOCIAL = ["div class=share", "div class=social", "ul class=social", "div class='share-buttons'", "div class=tags", "div class=tools"]
SYLLABLES = "an be co da el fi gu ha in jo ka lu mi no or pe qua re so tu un va wi xe yo ze sch tion ment ing er en é ü ñ ó ß à 的 ко".split()


class Page:
    """Writes html and notes each block's text and label."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.blocks = rng, [], []

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int = 1, high: int = 5) -> str:
        return " ".join(f"{self.words(1, 16).capitalize()}{self.rng.choice('....!?')}" for _ in range(self.rng.randint(low, high)))

    def label_text(self) -> str:
        """A few words as furniture has them, often with a cue."""
        cues = [self.rng.choice(sorted(CUES)) for _ in range(self.rng.randint(0, 2))]
        words = cues + [self.word() for _ in range(self.rng.randint(0 if cues else 1, 4))]
        return " ".join(words).capitalize()

    def block(self, tag: str, text: str, main: int, link: bool = False) -> None:
        self.blocks.append((text, main))
        inner = f'<a href="/{len(self.out)}">{text}</a>' if link else text
        if not link and self.rng.random() < 0.15:
            cut = text.split(" ")
            k = self.rng.randrange(len(cut))
            cut[k] = self.rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="x">{}</a>', "<span>{}</span>"]).format(cut[k])
            inner = " ".join(cut)
        close = "" if tag == "p" and self.rng.random() < 0.15 else f"</{tag.split()[0]}>"
        self.out.append(f"<{tag}>{inner}{close}")

    def inside(self, shell: str, fill: Callable[[], None]) -> None:
        self.out.append(f"<{shell}>")
        fill()
        self.out.append(f"</{shell.split()[0]}>")

    # --- furniture ---------------------------------------------------------------------------------------------------

    def menu(self) -> None:
        def items() -> None:
            for _ in range(self.rng.randint(2, 8)):
                self.block("li", self.label_text(), 0, link=self.rng.random() < 0.9)

        shell = self.rng.choice(NAV)
        if shell.startswith(("ul", "menu")):
            self.inside(shell, items)
        else:
            self.inside(shell, lambda: self.inside(self.rng.choice(["ul", "ol", "div"]), items))

    def header(self) -> None:
        def fill() -> None:
            self.block(self.rng.choice(["h1", "h2", "div", "p", "div class=logo"]), self.label_text(), 0, link=self.rng.random() < 0.5)
            if self.rng.random() < 0.5:
                self.block(self.rng.choice(["p", "div"]), self.words(2, 8), 0)

        self.inside(self.rng.choice(HEADER), fill)

    def footer(self) -> None:
        def fill() -> None:
            for _ in range(self.rng.randint(1, 4)):
                rights = f"© {self.rng.randint(1995, 2030)} {self.word().capitalize()}. All rights reserved."
                text = self.rng.choice([rights, f"© {self.words(1, 4)}", f"© {self.word()} · {self.prose(1, 2)}", self.label_text(), f"{self.label_text()} | {self.label_text()}", self.prose(1, 3)])
                self.block(self.rng.choice(["p", "div", "li"]) if self.rng.random() < 0.7 else "p", text, 0, link=self.rng.random() < 0.3)

        self.inside(self.rng.choice(FOOTER), fill if self.rng.random() < 0.7 else lambda: self.bare(f"© {self.words(1, 3)} · {self.prose(1, 2)}"))

    def bare(self, text: str) -> None:
        """Text without an element of its own."""
        self.blocks.append((text, 0))
        self.out.append(text)

    def box(self, shells: list[str], prose: float, low: int = 1, high: int = 4) -> None:
        def fill() -> None:
            if self.rng.random() < 0.4:
                self.block(self.rng.choice(["h2", "h3", "h4"]), self.label_text(), 0)
            for _ in range(self.rng.randint(low, high)):
                long = self.rng.random() < prose
                self.block(self.rng.choice(["p", "div", "li", "p"]), self.prose(1, 4) if long else self.label_text(), 0, link=not long and self.rng.random() < 0.7)

        if self.rng.random() < 0.3:
            self.inside(self.rng.choice(shells), lambda: self.bare(self.prose(1, 3) if self.rng.random() < prose else self.label_text()))
        else:
            self.inside(self.rng.choice(shells), fill)

    def form(self) -> None:
        def fill() -> None:
            if self.rng.random() < 0.5:
                self.block("p", self.prose(1, 2), 0)
            self.block("div", self.label_text(), 0)
            self.out.append("<input type=text name=q>")
            self.block("button", self.label_text(), 0)

        self.inside(self.rng.choice(FORMS), fill)

    def comments(self) -> None:
        def fill() -> None:
            self.block(self.rng.choice(["h2", "h3"]), self.label_text(), 0)
            for _ in range(self.rng.randint(1, 4)):
                def one() -> None:
                    self.block(self.rng.choice(["div", "p", "cite class=author"]) if self.rng.random() < 0.9 else "h4", self.label_text(), 0)
                    self.block("p", self.prose(1, 4), 0)

                self.inside(self.rng.choice(["div class=comment", "div", "article class=comment", "li", "li class=comment", "div class=reply", "div class=post"]), one)

        self.inside(self.rng.choice(COMMENTS), fill)

    def furniture(self, times: float) -> None:
        while self.rng.random() < times:
            times *= 0.6
            self.rng.choice(
                [
                    self.menu,
                    lambda: self.box(SIDE, 0.4),
                    lambda: self.box(ADS, 0.8, 1, 2),
                    lambda: self.box(ADS, 0.8, 1, 2),
                    lambda: self.box(NOTICE, 0.7, 1, 2),
                    lambda: self.box(SOCIAL, 0.0),
                    self.form,
                ]
            )()

    # --- main text ---------------------------------------------------------------------------------------------------

    def main(self) -> None:
        if self.rng.random() < 0.85:
            self.block(self.rng.choice(["h1", "h1", "h2"]), self.rng.choice([self.prose(1, 1), self.words(2, 10).capitalize()]), 1)
        for _ in range(self.rng.randint(1, 14)):
            kind = self.rng.random()
            if kind < 0.72:
                self.block("p", self.rng.choice([self.prose(1, 6), self.prose(1, 2), self.word().capitalize() + "."]), 1)
            elif kind < 0.8:
                self.block(self.rng.choice(["h2", "h3", "h4"]), self.words(1, 7).capitalize(), 1)
            elif kind < 0.86:
                self.inside(self.rng.choice(["ul", "ol"]), lambda: [self.block("li", self.rng.choice([self.words(1, 8), self.prose(1, 2)]), 1) for _ in range(self.rng.randint(1, 5))])
            elif kind < 0.9:
                self.inside("blockquote", lambda: self.block("p", self.prose(1, 3), 1))
            elif kind < 0.92:
                self.block("pre", self.words(3, 20), 1)
            elif kind < 0.94:
                self.inside("table", lambda: self.inside("tr", lambda: [self.block("td", self.words(1, 5), 1) for _ in range(self.rng.randint(2, 4))]))
            elif kind < 0.96:
                self.block("div", self.prose(1, 4), 1)
            else:
                self.furniture(0.8)
        if self.rng.random() < 0.15:
            self.comments()

    def silent(self) -> None:
        """A page whose elements don't say what they are for: a block or more of prose, furniture only in few words."""
        shell = lambda: self.rng.choice(["div", "div", "td", "center", f"div id={self.rng.choice('xyzpq')}", f"div class={self.rng.choice('xyzpq')}"])

        def labels(low: int, high: int) -> None:
            for _ in range(self.rng.randint(low, high)):
                self.block(shell(), self.rng.choice([self.label_text(), f"© {self.label_text()}"]), 0, link=self.rng.random() < 0.5)

        def text() -> None:
            kind = self.rng.random()
            if kind < 0.25:
                parts = [self.prose(1, 4) for _ in range(self.rng.randint(1, 4))]
                self.blocks.append((" ".join(parts), 1))
                self.out.append("<br><br>".join(parts))
                return
            if self.rng.random() < 0.5:
                self.block(self.rng.choice(["h1", "h2"]), self.words(1, 8).capitalize(), 1)
            for _ in range(self.rng.randint(1, 6)):
                self.block("p" if kind < 0.85 else "div", self.prose(1, 4), 1)

        if self.rng.random() < 0.3:  # a table that lays out the page
            rows = [lambda: labels(1, 4), lambda: self.inside("td", text)]
            if self.rng.random() < 0.5:
                rows.append(lambda: labels(1, 2))
            self.inside("table", lambda: self.inside("tr", lambda: [fill() for fill in rows]))
            return
        furnished = self.rng.random() < 0.6
        if furnished:
            labels(1, 4)
        fill = text
        for _ in range(self.rng.choice([0, 1, 1, 2]) or int(furnished)):
            fill = lambda own=shell(), inner=fill: self.inside(own, inner)
        fill()
        if furnished:
            labels(0, 3)

    def whole(self) -> str:
        def body() -> None:
            if self.rng.random() < 0.5:
                self.header()
            if self.rng.random() < 0.8:
                self.menu()
            self.furniture(0.8)
            self.inside(self.rng.choice(MAIN), self.main)
            self.furniture(0.7)
            if self.rng.random() < 0.35:
                self.comments()
            if self.rng.random() < 0.85:
                self.footer()

        if self.rng.random() < SILENT:
            if self.rng.random() < 0.3:
                self.silent()
                return "".join(self.out)
            self.inside("body", self.silent)
            return "<html>" + "".join(self.out) + "</html>"
        fill = body
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            fill = lambda shell=self.rng.choice(WRAPS), inner=fill: self.inside(shell, inner)
        self.inside("body", fill)
        return "<!DOCTYPE html><html><head><meta charset=utf-8></head>" + "".join(self.out) + "</html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """Pages, each with its blocks' texts and labels (1: main text) in order."""
    for k in range(n):
        page = Page(random.Random(seed * 100_003 + k))
        yield page.whole(), page.blocks
