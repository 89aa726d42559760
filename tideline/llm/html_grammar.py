"""A grammar of common page layouts, for training the page classifier.

Article text carries ``MARK`` at the start of each text block; everything else
on a page is what an extractor should leave out. Hints in class and id
attributes come and go, so the classifier also learns from shape and place.
"""

from __future__ import annotations

import random

MARK = "\ue000"
_SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pe qui ra so ta un ve wi xi ya zo th st er ing tion ment able ous".split()
# Names that pages give to their parts.
ARTICLE_NAMES = ["article", "post", "entry-content", "content", "main", "post-body", "story", "article-body", "main-content", "text", "blog-post", "page-content"]
OTHER_NAMES = {
    "menu": ["nav", "menu", "navbar", "main-nav", "site-nav", "navigation", "topnav"], "header": ["header", "site-header", "masthead", "topbar", "page-header"],
    "footer": ["footer", "site-footer", "page-footer", "bottom", "copyright", "footer-links"], "sidebar": ["sidebar", "side", "aside", "right-sidebar", "widget-area", "rail", "widget"],
    "notice": ["cookie-notice", "notice", "cookie-banner", "gdpr-consent", "alert", "site-notice", "notification", "disclaimer", "warning-banner", "consent"],
    "advert": ["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo", "advertisement", "adsbox", "sponsor"],
    "comments": ["comments", "comment-list", "comment", "replies", "discussion", "reader-comments", "responses"],
    "form": ["newsletter", "subscribe", "search-form", "login", "signup", "contact-form", "search"],
    "related": ["related", "recommended", "more-stories", "popular", "trending", "related-posts"], "share": ["share", "social", "share-buttons", "follow-us"],
    "crumbs": ["breadcrumb", "breadcrumbs", "pagination", "pager", "tags"],
}
_PLAIN = ["box", "c1", "c2", "wrap", "inner", "row", "col", "container", "block", "x7", "grid", "unit", "module", "s-12", "panel"]


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.hints = rng.random() < 0.8
        self.words_per = rng.choice([6, 14, 40, 60, 90])
        self.vocabulary = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(150)]

    def some(self, share: float) -> bool:
        return self.r.random() < share

    def words(self, low: int, high: int) -> str:
        out, start = [], True
        for _ in range(self.r.randint(low, high)):
            word = self.r.choice(self.vocabulary)
            out.append(word.capitalize() if start else word)
            start = self.some(0.1)
            if start:
                out[-1] += "."
            elif self.some(0.08):
                out[-1] += ","
            if self.some(0.01):
                out[-1] += "&amp;&amp;"
        return " ".join(out)

    def prose(self) -> str:
        return self.words(1, self.r.choice([4, 15, self.words_per, 2 * self.words_per]))

    def names(self, kind: str, always: bool = False) -> str:
        if always or (self.hints and self.some(0.9)):
            name = self.r.choice(OTHER_NAMES.get(kind) or ARTICLE_NAMES)
            return f' {self.r.choice(["class", "class", "id"])}="{name}{self.r.choice(["", "", " " + self.r.choice(_PLAIN), "-1"])}"'
        return f' class="{self.r.choice(_PLAIN)}"' if self.some(0.4) else ""

    def links(self, count: int) -> str:
        items = [f'<a href="/{self.r.choice(self.vocabulary)}">{self.words(1, 4)}</a>' for _ in range(count)]
        style = self.r.random()
        if style < 0.6:
            tag = self.r.choice(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{tag}>"
        return (" | " if style < 0.8 else " ").join(items)

    def paragraph(self, text: str) -> str:
        style = self.r.random()
        if style < 0.55:
            return f"<p>{text}</p>"
        if style < 0.65:
            inline = self.r.choice(["b", "i", "em", "span", "font", "u", "strong"])  # never closed
            return f"<{self.r.choice(['p', 'p', 'div'])}><{inline}>{text}{self.r.choice(['', '<br>', '<br/>', '<br><br>'])}" + self.r.choice(["", "</div>", "</p>"])
        if style < 0.75:
            return f"<p>{text}"
        if style < 0.85:
            half = len(text) // 2
            space = text.find(" ", half)
            return f'<p>{text[:space]} <a href="/x">{text[space:]}</a></p>' if space > 0 and self.some(0.5) else f"<p><em>{text}</em></p>"
        if style < 0.93:
            return f"<div>{text}</div>"
        return f"<p>{text}</p>\n"

    # What an extractor keeps.
    def article(self) -> str:
        parts = [f"<h{k}>{MARK}{self.words(2, 10)}</h{k}>" for k in [self.r.choice([1, 1, 2])] if self.some(0.85)]
        for _ in range(self.r.choice([0, 1, 2, 3, 5, 8, 14])):
            x = self.r.random()
            if x < 0.78:
                parts.append(self.paragraph(MARK + self.prose()))
            elif x < 0.83:
                parts.append(f"<h{self.r.randint(2, 4)}>{MARK}{self.words(1, 8)}</h3>".replace("</h3>", "</h2>"))
            elif x < 0.88:
                tag = self.r.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{MARK}{self.words(2, 20)}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>")
            elif x < 0.92:
                parts.append(f"<blockquote>{self.paragraph(MARK + self.prose())}</blockquote>")
            elif x < 0.95:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            elif x < 0.98:
                parts.append(f'<figure><img src="/i.png"><figcaption>{MARK}{self.words(3, 14)}</figcaption></figure>')
            else:
                parts.append(f"<pre>{MARK}{self.words(4, 20)}</pre>")
        if not any(MARK in p for p in parts):
            parts.append(self.paragraph(MARK + self.prose()))
        for kind in ("advert", "share", "related", "form", "notice", "comments", "crumbs"):
            if self.some(0.12):
                parts.insert(self.r.randint(0, len(parts)) if kind in ("advert", "form", "notice", "share") else len(parts), getattr(self, kind)(True))
        body = "".join(parts)
        x = self.r.random()
        if x < 0.45:
            body = f"<article{self.names('article') if self.some(0.3) else ''}>{body}</article>"
        elif x < 0.6:
            body = f"<main>{body}</main>"
        elif x < 0.9:
            body = f"<div{self.names('article')}>{body}</div>"
        elif x < 0.95:
            body = f"<section{self.names('article')}>{body}</section>"
        if self.some(0.15):
            body = f"<div{self.names('article')}>{body}</div>"
        return f"<main>{body}</main>" if self.some(0.15) else body

    # What it leaves out.
    def menu(self, named: bool = False) -> str:
        tag = self.r.choice(["nav", "nav", "nav", "div", "ul"])
        inner = self.links(self.r.randint(2, 12))
        return f"<{tag}{self.names('menu', named or tag != 'nav') if tag != 'nav' or self.some(0.4) else ''}>{inner}</{tag}>"

    def header(self, named: bool = False) -> str:
        tag = self.r.choice(["header", "header", "div"])
        inner = self.r.choice([f"<h1>{self.words(1, 5)}</h1>", f'<a href="/">{self.words(1, 4)}</a>', f"<div>{self.words(1, 6)}</div>", f"<p>{self.words(2, 14)}</p>", self.words(1, 12)])
        return f"<{tag}{self.names('header', named or tag == 'div') if tag == 'div' or self.some(0.5) else ''}>{inner}{self.menu() if self.some(0.3) else ''}</{tag}>"

    def footer(self, named: bool = False) -> str:
        tag = self.r.choice(["footer", "footer", "div"])
        text = f"{self.r.choice(['&copy; ', '&copy; 2024 ', 'Copyright ', ''])}{self.words(1, 20)}"
        inner = self.r.choice([text, f"<p>{text}</p>", f"<p>{text}</p>{self.links(4)}", self.links(5) + text])
        return f"<{tag}{self.names('footer', named or tag == 'div') if tag == 'div' or self.some(0.5) else ''}>{inner}</{tag}>"

    def _prose_box(self, kind: str, tags: list[str], low: int = 1, high: int = 3) -> str:
        tag = self.r.choice(tags)
        if tag == "p":
            return f"<p{self.names(kind, True)}>{self.prose()}</p>"
        inner = "".join(self.r.choice([f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p>", self.words(2, 30), f"<div>{self.prose()}</div>"]) for _ in range(self.r.randint(low, high)))
        if self.some(0.3):
            inner = f"<h{self.r.randint(2, 4)}>{self.words(1, 4)}</h2>".replace("</h2>", "</h3>") + inner
        return f"<{tag}{self.names(kind, tag != 'aside') if tag != 'aside' or self.some(0.6) else ''}>{inner}</{tag}>"

    def sidebar(self, named: bool = False) -> str:
        if self.some(0.5):
            return self._prose_box("sidebar", ["aside", "aside", "div", "section"])
        tag = self.r.choice(["aside", "aside", "div"])
        return f"<{tag}{self.names('sidebar', tag == 'div') if tag == 'div' or self.some(0.6) else ''}><h3>{self.words(1, 3)}</h3>{self.links(self.r.randint(3, 9))}{self.advert(True) if self.some(0.2) else ''}</{tag}>"

    def notice(self, named: bool = False) -> str:
        box = self._prose_box("notice", ["div", "div", "section", "p"], 1, 2)
        return box if self.some(0.6) else box.replace("</", f"<button>{self.words(1, 2)}</button></", 1) if "<p>" not in box else box

    def advert(self, named: bool = False) -> str:
        x = self.r.random()
        if x < 0.6:
            return self._prose_box("advert", ["div", "div", "section", "aside", "p"], 1, 2)
        if x < 0.8:
            return f"<div{self.names('advert', True)}>{self.words(3, 25)}</div>"
        return f'<div{self.names("advert", True)}><a href="/buy">{self.words(3, 20)}</a></div>'

    def comments(self, named: bool = False) -> str:
        one = lambda: f'<{t}{self.names("comments", True)}>{self.r.choice(["", f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 2)}</h4>"])}{self.r.choice([f"<p>{self.prose()}</p>", self.prose()])}</{t}>'
        tag, t = self.r.choice([("div", "div"), ("section", "div"), ("section", "article"), ("ul", "li"), ("ol", "li"), ("section", "p")])
        return f"<{tag}{self.names('comments', True)}>{f'<h3>{self.words(1, 3)}</h3>' if self.some(0.5) else ''}{''.join(one() for _ in range(self.r.randint(1, 6)))}{self.form(True) if self.some(0.3) else ''}</{tag}>"

    def form(self, named: bool = False) -> str:
        fields = "".join(self.r.choice([f"<label>{self.words(1, 4)}</label><input name='a'>", f"<p>{self.words(2, 20)}</p>", "<input type=text>", "<textarea>x y</textarea>", f"<select><option>{self.words(1, 2)}</option></select>"]) for _ in range(self.r.randint(1, 4)))
        return f"<form{self.names('form') if self.some(0.5) else ''}>{self.words(1, 12) if self.some(0.4) else ''}{fields}<button>{self.words(1, 2)}</button></form>"

    def related(self, named: bool = False) -> str:
        return f"<div{self.names('related', True)}><h3>{self.words(1, 3)}</h3>{self.links(self.r.randint(2, 6))}</div>"

    def share(self, named: bool = False) -> str:
        return f"<div{self.names('share', True)}>{self.links(self.r.randint(2, 5))}</div>"

    def crumbs(self, named: bool = False) -> str:
        return f"<div{self.names('crumbs', True)}>{self.links(self.r.randint(2, 5))}</div>"

    def render(self) -> str:
        top = [k for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.75), ("crumbs", 0.15), ("advert", 0.35), ("form", 0.15)) if self.some(p)]
        if self.some(0.4):
            self.r.shuffle(top)
        end = [k for k, p in (("share", 0.15), ("advert", 0.25), ("related", 0.2), ("comments", 0.35), ("form", 0.15), ("notice", 0.15), ("menu", 0.1)) if self.some(p)]
        side = [self.sidebar()] if self.some(0.4) else []
        middle = [self.article(), *side]
        if self.some(0.25):
            middle.reverse()
        inner = "".join(middle) + "".join(getattr(self, k)() for k in end)
        for _ in range(self.r.choice([0, 0, 1, 2])):
            inner = f"<div{self.r.choice(['', ' class=wrap', ' id=page', ' class=container'])}>{inner}</div>"
        body = "".join(getattr(self, k)() for k in top) + inner + (self.footer() if self.some(0.85) else "")
        gap = self.r.choice(["", "", "\n", "\n  "])
        body = body.replace("><", f">{gap}<") if gap else body
        return f"{self.head()}<body>{body}{self.r.choice(['', '</body>', '</body></html>'])}"

    def head(self) -> str:
        """A document type and a head, either of which may be missing, with some of what heads hold."""
        w = self.r.choice(self.vocabulary)
        parts = [
            f"<title>{self.words(2, 9)}</title>", f'<meta name="description" content="{self.words(4, 12)}">', '<meta name="viewport" content="width=device-width">', f'<link rel="stylesheet" href="/{w}.css">',
            f"<style>.{w} > a {{ color: #333 }} /* <div> */</style>", f'<script src="/{w}.js"></script>', f"<script>if (1 < 2) {{ document.write('<nav>{w}</nav>') }}</script>", f'<script type="application/ld+json">{{"name": "{w}"}}</script>',
            f"<noscript><img src='/{w}.gif'></noscript>", f"<!-- {w} <article> -->",
        ]
        head = "".join(p for p in self.r.sample(parts, len(parts)) if self.some(0.4))
        return self.r.choice(["<!DOCTYPE html>", "<!doctype html>\n", ""]) + self.r.choice(["<html>", '<html lang="xx">', ""]) + (f"<head>{head}</head>" if self.some(0.9) else "")


def labelled_pages(count: int, seed: int = 11) -> list[str]:
    """So many pages, the same ones each time."""
    rng = random.Random(seed)
    return [_Page(rng).render() for _ in range(count)]
