"""Labelled pages for the weights of ``html_text``: layouts made by rule, each stretch marked as main text or not.

The words are noise: what is learned is where main text stands, how long its
blocks are, how much of them are links, and which names of elements go with it.
"""

from __future__ import annotations

import random

NAMES = {
    "menu": "nav navbar navigation menu main-menu top-nav breadcrumb breadcrumbs toolbar pagination pager skip-link",
    "ad": "ad ads advert advertisement advertising banner promo promotion sponsored sponsor ad-slot adsbox",
    "notice": "cookie cookies cookie-consent consent notice site-notice alert popup modal overlay gdpr",
    "side": "sidebar side aside widget related related-posts recommended most-read teaser",
    "share": "share sharing share-buttons social social-links follow",
    "sign": "newsletter subscribe signup login search search-box",
    "comments": "comments comment comment-list reader-comments respond discussion replies disqus",
    "foot": "footer site-footer page-footer footer-links copyright legal imprint colophon bottom",
    "head": "header site-header page-header masthead topbar brand logo",
    "content": "content post entry entry-content article article-body story text post-body page-content main-content main",
    "wrapper": "page wrapper container layout site page-with-sidebar has-sidebar no-comments with-ads layout-menu-left row theme-dark",
    "topic": "intro legal history notice menu results methods summary part chapter copyright",
}
ROLES = {"menu": "navigation", "notice": "dialog alert", "side": "complementary", "sign": "search", "foot": "contentinfo", "head": "banner", "content": "main article"}
TAGS = {"menu": "nav nav div div ul", "ad": "div div div section aside", "notice": "div div section dialog", "side": "aside aside div section", "share": "div ul", "sign": "form form div section", "comments": "section div div ol", "foot": "footer footer div", "head": "header header div"}


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[tuple[bool, str]] = []

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, lo: int, hi: int) -> str:
        return " ".join("".join(self.r.choices("abcdefghij", k=self.r.randint(1, 8))) for _ in range(self.r.randint(lo, hi)))

    def put(self, inside: bool, markup: str) -> None:
        self.out.append((inside, markup))

    def open(self, kind: str, tag: str, named: float = 0.75) -> str:
        """A start tag, with a class or id of its kind, a made-up one, a role, or nothing."""
        marks = ""
        if self.chance(named):
            marks = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(NAMES[kind].split())}"'
        elif self.chance(0.5):
            marks = f' class="{self.words(1, 2)}"'
        if kind in ROLES and self.chance(0.15):
            marks += f' role="{self.r.choice(ROLES[kind].split())}"'
        return f"<{tag}{marks}>"

    def link(self, lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.words(lo, hi)}</a>'

    def links(self, lo: int, hi: int) -> str:
        own = [self.link() for _ in range(self.r.randint(lo, hi))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>" if self.chance(0.6) else self.r.choice([" | ", " ", "<br>"]).join(own)

    def phrase(self, lo: int, hi: int) -> str:
        """Running text with some inline markup."""
        t = self.words(lo, hi)
        if self.chance(0.2):
            t += f" <b>{self.words(1, 3)}</b>"
        if self.chance(0.2):
            t += f" {self.link()} {self.words(1, 8)}"
        return t + "."

    def short_list(self) -> str:
        return "<ul>" + "".join(f"<li>{self.link(3, 9)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"

    def other(self, kind: str, named: float = 0.75) -> None:
        """A part that is not main text."""
        tag = self.r.choice(TAGS[kind].split())
        body = {
            "menu": lambda: self.links(3, 9),
            "ad": lambda: self.r.choice([self.phrase(4, 16), f"<p>{self.phrase(3, 14)}</p>", self.link(3, 9)]),
            "notice": lambda: f"<p>{self.phrase(5, 22)}</p><button>{self.words(1, 2)}</button>",
            "side": lambda: f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([self.short_list(), f"<p>{self.phrase(4, 18)}</p>" + self.short_list()]),
            "share": lambda: self.links(2, 5),
            "sign": lambda: f"<p>{self.words(3, 10)}</p><label>{self.words(1, 2)}</label><input><button>{self.words(1, 1)}</button>",
            "comments": lambda: f"<h3>{self.words(1, 3)}</h3>" + "".join(self.open("comments", t, named) + f"<b>{self.words(1, 2)}</b><p>{self.phrase(2, 30)}</p></{t}>" for t in self.r.choices(["div", "article", "section"], k=self.r.randint(1, 5))),
            "foot": lambda: self.r.choice([f"&copy; {self.words(2, 8)}", f"<p>{self.words(3, 12)}</p>{self.links(2, 5)}", self.links(2, 7)]),
            "head": lambda: (f"<h1>{self.words(1, 3)}</h1>" if self.chance(0.3) else self.link()) + (self.links(2, 6) if self.chance(0.5) else ""),
        }[kind]()
        if tag in ("ul", "ol"):
            body = f"<li>{body}</li>"
        bare = tag in ("div", "section", "ul", "ol")  # nothing else tells what it is
        self.put(False, self.open(kind, tag, named if bare else 0.5) + body + f"</{tag}>")

    def blocks(self, flow: bool) -> None:
        """Blocks of main text, with other parts between some."""
        for _ in range(self.r.randint(1, 9)):
            kind = self.r.random()
            if flow and kind < 0.6:
                self.put(True, self.phrase(25, 90) + "<br><br>")
            elif kind < 0.5:
                self.put(True, f"<p>{self.phrase(8, 70)}</p>")
            elif kind < 0.62:
                self.put(True, f"<p>{self.phrase(1, 9)}</p>")
            elif kind < 0.7:
                self.put(True, f"<p>{self.phrase(20, 60)}<p>{self.phrase(8, 40)}")
            elif kind < 0.78:
                self.put(True, f"<h2>{self.words(1, 7)}</h2><p>{self.phrase(10, 50)}</p>")
            elif kind < 0.84:
                items = "".join(f"<li>{self.phrase(2, 16)}</li>" for _ in range(self.r.randint(2, 6)))
                self.put(True, f"<ul>{items}</ul>" if self.chance(0.6) else f"<ol>{items}</ol>")
            elif kind < 0.88:
                self.put(True, f"<blockquote>{self.phrase(6, 40)}</blockquote>")
            elif kind < 0.92:
                self.put(True, "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.95:
                self.put(True, f"<pre>{self.words(4, 30)}</pre><figure><img><figcaption>{self.words(3, 10)}</figcaption></figure>")
            else:
                self.put(True, f"{self.open('topic', 'section')}<h3>{self.words(1, 4)}</h3><p>{self.phrase(8, 50)}</p></section>")
            if self.chance(0.12):
                self.other(self.r.choice(["ad", "ad", "share", "sign", "side", "menu"]), 0.95)

    def page(self) -> list[tuple[bool, str]]:
        self.put(False, f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><script>var a = 1;</script></head>" + self.open("wrapper", "body", 0.3))
        depth = self.r.randint(0, 2)
        around = self.r.choice(["div", "div", "form"]) if self.chance(0.1) else "div"
        for _ in range(depth):
            self.put(False, self.open("wrapper", around))
        shape = self.r.choice(["article", "article", "article", "main", "main article", "div", "div", "div", "td", ""])
        strict = shape in ("div", "td", "")  # other parts must be told by their names and shapes
        named = 0.85 if strict else 0.6
        for kind, p in (("notice", 0.3), ("head", 0.6), ("menu", 0.8), ("ad", 0.3), ("side", 0.15)):
            if self.chance(p):
                self.other(kind, named)
        for tag in shape.split():
            tag_open = self.open("content", tag, 0.5) if tag in ("article", "main", "div") else "<table><tr><td>"
            self.put(False, tag_open)
        if self.chance(0.85):
            title = f"<h1>{self.words(1, 10)}</h1>"
            self.put(True, f"<header>{title}</header>" if "article" in shape and self.chance(0.3) else title)
        self.blocks(self.chance(0.25))
        if "article" in shape and self.chance(0.25):
            self.other("comments", 0.9)
        if shape:
            self.put(False, "</td></tr></table>" if shape == "td" else "".join(f"</{t}>" for t in reversed(shape.split())))
        for kind, p in (("share", 0.2), ("side", 0.5), ("comments", 0.4), ("ad", 0.2), ("sign", 0.25), ("foot", 0.85)):
            if self.chance(p):
                self.other(kind, named)
        self.put(False, f"</{around}>" * depth + "</body></html>")
        return self.out


def pages(n: int, first: int = 0) -> list[list[tuple[bool, str]]]:
    """``n`` pages, each a list of (is main text, markup); page k of any list is the same."""
    return [_Writer(first + k).page() for k in range(n)]
