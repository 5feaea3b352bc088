"""Labelled pages to train on: made by rules from a seed, each with the text that a reader of its article would want.

Layouts, names and markup vary as pages of the web do, words are invented from syllables of several scripts. What surrounds an article, and
what some pages put into it, is menus, headers, notices, adverts, forms, side columns, comments and footers.
"""

from __future__ import annotations

import html
import random
from collections.abc import Callable

# Syllables of invented words, and names that pages give their parts.
SYLLABLES = (
    "the an re ing er on at st en nd ou ha ti es ea ble".split(), "ein sch ver lich keit und ge zu ä ö ü ung mit nie".split(),
    "le que eau tion ment é è ou aux oi ai vi pa re".split(), "de la os as ción ar es ado ñ á ó cie ue nte".split(),
    "на по ст ра ов ен ко го ть пре ни ла".split(), "的 是 在 了 有 和 人 中 大 上 国 時 日 本".split(),
)
MARKS = ("", "", "", "", "***", "$$$", "%%%", "&", "<b>", "'s", '"')
MAIN = "article post content entry main story text body page single blog news detail prose rich read".split()
MENU = "menu nav navbar navigation topnav links breadcrumb breadcrumbs tabs toolbar pagination sitemap categories".split()
HEAD = "header masthead top banner logo branding site title tagline hero".split()
SIDE = "sidebar side aside related widget popular recommended trending more teaser rail tags archive recent".split()
NOTICE = "notice cookie consent alert gdpr popup modal overlay message warning disclaimer privacy toast".split()
ADVERT = "ad ads advert advertisement sponsored promo promotion sponsor banner commercial adsense".split()
FORM = "form newsletter subscribe search login signup contact feedback poll".split()
TALK = "comments comment discussion responses reply replies respond disqus thread reviews feedback".split()
FOOT = "footer foot bottom copyright legal colophon imprint credits".split()
SHARE = "share social sharing follow tools actions meta byline author".split()
PLAIN = "wrapper container row col inner box section block grid group left right wrap outer layout".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.lexicon = ["".join(rng.choice(kinds) for _ in range(rng.randint(1, 4))) for kinds in [rng.choice(SYLLABLES)] for _ in range(150)]
        self.marked = rng.random() < 0.3
        self.out: list[str] = []
        self.gold: list[str] = []

    def some(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, lo: int, hi: int) -> str:
        r = self.rng
        out = [r.choice(self.lexicon) + (r.choice(MARKS) if self.marked else "") for _ in range(r.randint(lo, hi))]
        return " ".join(out).capitalize()

    def prose(self, lo: int, hi: int) -> str:
        """Sentences of lo to hi words in all."""
        r, left, out = self.rng, self.rng.randint(lo, hi), []
        while left > 0:
            n = min(left, r.randint(1, 18))
            words = self.words(n, n).split(" ")
            out.append(" ".join(w + ("," if 0 < k < n - 1 and r.random() < 0.1 else "") for k, w in enumerate(words)) + r.choice("......!?"))
            left -= n
        return " ".join(out)

    def odd(self, n: int) -> str:
        """What isn't prose, but stands in articles: words with bars, words that repeat, numbers, signs, capitals, no stop at the end."""
        r = self.rng
        words = self.words(n, n).split(" ")
        form = r.randrange(5)
        if form == 0:
            return r.choice((" | ", " / ", " · ", " » ", "; ")).join(words)
        if form == 1:
            return " ".join(w for w in words for _ in range(r.randint(1, 6)))
        if form == 2:
            return " ".join(str(r.randrange(10 ** r.randint(1, 9))) for _ in words)
        if form == 3:
            return " ".join(r.choice(("#", "@", "--", "==", "{", "}", "©", "*", "://", w)) for w in words)
        return " ".join(words).upper()

    def attributes(self, names: list[str], p: float = 1.0) -> str:
        r = self.rng
        if not self.some(p):
            return ""
        name = r.choice(names)
        if self.some(0.4):
            name += r.choice("-_") + r.choice([*names, "list", "item", "area", "inner", "wrap", "1", "box"])
        if self.some(0.2):
            name += f" {r.choice(PLAIN)}"
        key = "id" if self.some(0.25) else "class"
        quote = r.choice(('"', '"', '"', "'"))
        return f" {key}={quote}{name}{quote}"

    def text(self, t: str) -> str:
        """The text as markup: escaped, with white space, inline tags or an odd reference here and there."""
        r = self.rng
        words = html.escape(t, quote=self.some(0.5)).split(" ")
        if self.some(0.3) and len(words) > 4:
            k = r.randrange(len(words) - 2)
            tag = r.choice(("b", "i", "em", "strong", "span", "a", "code", "a"))
            link = f' href="/{r.randrange(99)}"' if tag == "a" else ""
            words[k] = f"<{tag}{link}>{words[k]}"
            words[k + 1] += f"</{tag}>"
        gap = r.choice((" ", " ", " ", " ", "\n", "  ", "&nbsp;", "&#32;"))
        k = r.randrange(len(words))
        return " ".join(words[:k]) + (gap if k else "") + " ".join(words[k:])

    def add(self, *parts: str) -> None:
        self.out += parts

    def content(self, tag: str, t: str, attributes: str = "", end: bool = True) -> None:
        self.gold.append(" ".join(t.split()))
        self.add(f"<{tag}{attributes}>{self.text(t)}" + (f"</{tag}>" if end else ""))

    def links(self, n: int) -> None:
        """A list of links: list items, paragraphs, cells or a row with bars."""
        form = self.rng.choice(("li", "li", "li", "div", "bar", "td"))
        item = lambda: f'<a href="/{self.rng.randrange(999)}">{html.escape(self.words(1, self.rng.choice((1, 2, 4, 8))))}</a>'
        if form == "bar":
            self.add(self.rng.choice((" | ", " &middot; ", " &raquo; ", " / ", " ", "\n")).join(item() for _ in range(n)))
        elif form == "div":
            self.add(*[f"<div>{item()}</div>" for _ in range(n)])
        elif form == "td":
            self.add("<table><tr>", *[f"<td>{item()}</td>" for _ in range(n)], "</tr></table>")
        else:
            tag = self.rng.choice(("ul", "ul", "ol"))
            self.add(f"<{tag}>", *[f"<li>{item()}" + ("</li>" if self.some(0.8) else "") for _ in range(n)], f"</{tag}>")

    # What isn't wanted.

    def menu(self) -> None:
        tag = self.rng.choice(("nav", "nav", "nav", "div", "div", "menu", "section"))
        self.add(f"<{tag}{self.attributes(MENU, 0.5 if tag == 'nav' else 1.0)}>")
        self.links(self.rng.randint(2, 12))
        self.add(f"</{tag}>")

    def header(self) -> None:
        tag = self.rng.choice(("header", "header", "div"))
        self.add(f"<{tag}{self.attributes(HEAD, 0.5 if tag == 'header' else 1.0)}>")
        inner, title = self.rng.choice(("div", "p", "h1", "h1", "h2")), html.escape(self.words(1, self.rng.choice((3, 8))))
        self.add(f"<{inner}><a href='/'>{title}</a></{inner}>" if self.some(0.5) else f"<{inner}>{title}</{inner}>")
        if self.some(0.6):
            self.add(f"<p>{self.text(self.words(2, 9) if self.some(0.5) else self.prose(2, 30))}</p>")
        if self.some(0.4):
            self.menu()
        self.add(f"</{tag}>")

    def boxed(self, tags: tuple[str, ...], names: list[str], lo: int, hi: int, link: float = 0.3) -> None:
        """A box of short or longer prose, perhaps with a link or a button."""
        tag = self.rng.choice(tags)
        self.add(f"<{tag}{self.attributes(names, 0.5 if tag in ('aside', 'footer', 'header') else 1.0)}>")
        if self.some(0.3):
            self.add(f"<h3>{self.text(self.words(1, 4))}</h3>")
        inner = self.rng.choice(("", "", "p", "p", "div", "span"))
        said = self.prose(lo, hi)
        self.add(f"<{inner}>{self.text(said)}</{inner}>" if inner else self.text(said))
        if self.some(link):
            self.add(self.rng.choice(("<a href='#'>{}</a>", "<button>{}</button>", "<p><a href='/x'>{}</a></p>")).format(html.escape(self.words(1, 3))))
        self.add(f"</{tag}>")

    def advert(self) -> None:
        self.boxed(("div", "div", "div", "ins", "section", "aside"), ADVERT if self.some(0.6) else ADVERT[:3], 2, 60)

    def notice(self) -> None:
        self.boxed(("div", "div", "section", "aside", "dialog"), NOTICE, 5, 45, 0.6)

    def aside(self) -> None:
        """Prose and nothing else, as long as a paragraph of the article."""
        tag = self.rng.choice(("aside", "aside", "div"))
        said = "".join(f"<p>{self.text(self.prose(5, 70))}</p>" for _ in range(self.rng.randint(1, 3)))
        self.add(f"<{tag}{self.attributes(self.rng.choice((SIDE, NOTICE, ADVERT)), 0.4 if tag == 'aside' else 1.0)}>{said}</{tag}>")

    def form(self) -> None:
        self.add(f"<form{self.attributes(FORM, 0.6)}>")
        if self.some(0.5):
            self.add(f"<p>{self.text(self.prose(3, 20))}</p>")
        for _ in range(self.rng.randint(1, 4)):
            self.add(f"<label>{html.escape(self.words(1, 3))}</label><input type=text>" if self.some(0.6) else f"<div>{html.escape(self.words(1, 4))} <input></div>")
        if self.some(0.3):
            self.add("<select>", *[f"<option>{html.escape(self.words(1, 2))}</option>" for _ in range(4)], "</select>")
        self.add(f"<button>{html.escape(self.words(1, 2))}</button></form>")

    def side(self) -> None:
        tag = self.rng.choice(("aside", "aside", "div", "div", "section"))
        self.add(f"<{tag}{self.attributes(SIDE, 0.5 if tag == 'aside' else 1.0)}>")
        for _ in range(self.rng.randint(1, 3)):
            self.add(f"<{h}>{self.text(self.words(1, 4))}</{h}>" if (h := self.rng.choice(("h2", "h3", "h4", "div"))) else "")
            if self.some(0.6):
                self.links(self.rng.randint(2, 8))
            else:
                self.add(f"<p>{self.text(self.prose(4, 40))}</p>")
        self.add(f"</{tag}>")

    def talk(self) -> None:
        outer, inner = self.rng.choice((("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("div", "article"), ("section", "article"), ("aside", "p")))
        self.add(f"<{outer}{self.attributes(TALK)}>")
        if self.some(0.7):
            title = f"<h3>{self.text(self.words(1, 3))}</h3>"
            self.add(f"<li>{title}</li>" if outer in ("ol", "ul") else title)
        for _ in range(self.rng.randint(1, 7)):
            self.add(f"<{inner}{self.attributes(TALK, 0.6)}>")
            if inner != "p" and self.some(0.7):
                self.add(self.rng.choice(("<b>{}</b>: ", "<p>{}</p>", "<div class='author'>{}</div>", "<cite>{}</cite> ")).format(html.escape(self.words(1, 2))))
            said = self.text(self.prose(2, 70))
            self.add(f"<p>{said}</p>" if inner != "p" and self.some(0.6) else said, f"</{inner}>")
        self.add(f"</{outer}>")
        if self.some(0.3):
            self.form()

    def share(self) -> None:
        self.add(f"<div{self.attributes(SHARE)}>")
        self.links(self.rng.randint(2, 5))
        self.add("</div>")

    def footer(self) -> None:
        tag = self.rng.choice(("footer", "footer", "div"))
        self.add(f"<{tag}{self.attributes(FOOT, 0.5 if tag == 'footer' else 1.0)}>")
        if self.some(0.4):
            self.links(self.rng.randint(2, 8))
        if self.some(0.3):
            self.add(f"<p>{self.text(self.prose(3, 40))}</p>")
        mark = self.rng.choice(("&copy; ", "© 2024 ", "", "", "&#169; "))
        self.add(f"{mark}{self.rng.choice(('m.', 'www.', ''))}{self.rng.choice(self.lexicon)}.example.net{self.rng.choice((' &middot; ', ' | ', ' '))}{self.text(self.prose(2, 14))}")
        self.add(f"</{tag}>")

    # What is.

    def part(self) -> None:
        r = self.rng
        kind = r.choice(("p",) * 16 + ("h2", "h3", "list", "quote", "pre", "table", "figure", "div", "broken", "broken", "odd", "odd"))
        if kind == "p":
            self.content("p", self.prose(1, r.choice((1, 3, 12, 40, 90, 160))), end=self.some(0.85))
        elif kind == "odd":
            self.content("p", self.odd(r.randint(1, 60)), end=self.some(0.85))
        elif kind == "broken":
            self.gold.append(" ".join((t := self.prose(1, 30)).split()))
            self.add(f"<p><b>{self.text(t)}<br>")
        elif kind in ("h2", "h3"):
            self.content(kind, self.words(1, 9))
        elif kind == "list":
            tag = r.choice(("ul", "ol"))
            self.add(f"<{tag}>")
            for _ in range(r.randint(2, 6)):
                self.content("li", self.prose(1, 25) if self.some(0.6) else self.words(1, 8), end=self.some(0.7))
            self.add(f"</{tag}>")
        elif kind == "quote":
            self.add("<blockquote>")
            self.content("p", self.prose(4, 50))
            self.add("</blockquote>")
        elif kind == "pre":
            self.content("pre", self.words(2, 20))
        elif kind == "table":
            self.add("<table>")
            for _ in range(r.randint(1, 4)):
                self.add("<tr>")
                for _ in range(3):
                    self.content("td", self.words(1, 4))
                self.add("</tr>")
            self.add("</table>")
        elif kind == "figure":
            self.add('<figure><img src="a.png" alt="x">')
            self.content("figcaption", self.prose(3, 20))
            self.add("</figure>")
        else:
            self.content("div", self.prose(5, 60))

    def article(self) -> None:
        r = self.rng
        outer = r.choice(
            (("article",), ("article",), ("article",), ("main", "article"), ("main",), ("div", "article"), ("div",), ("div", "div"), ("section",), ("table", "tr", "td"))
        )
        for k, tag in enumerate(outer):
            named = 0.0 if tag in ("table", "tr") else 0.4 if tag in ("article", "main") else 0.9 if k == len(outer) - 1 else 0.4
            self.add(f"<{tag}{self.attributes(MAIN if k == len(outer) - 1 or tag == 'main' else PLAIN, named)}>")
        if self.some(0.85):
            self.content(r.choice(("h1", "h1", "h1", "h2")), self.words(1, 14))
        noise = [self.advert, self.advert, self.notice, self.aside, self.side, self.form, self.share] if self.some(0.6) else []
        n = r.choice((1, 2, 4, 8, 16, 25))
        for k in range(n):
            self.part()
            if noise and self.some(0.25) and k < n - 1:
                r.choice(noise)()
        if noise and self.some(0.4):
            r.choice([*noise, self.talk])()
        self.add(*[f"</{tag}>" for tag in reversed(outer)])

    def built(self) -> tuple[str, str]:
        r = self.rng
        self.add(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{html.escape(self.words(2, 9))}</title><style>p{{margin:0}}</style></head><body{self.attributes(PLAIN, 0.2)}>")
        wrap = self.some(0.4)
        if wrap:
            self.add(f"<div{self.attributes(PLAIN)}>")
        before: list[tuple[Callable[[], None], float]] = [(self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.advert, 0.4), (self.side, 0.2), (self.aside, 0.15), (self.form, 0.15)]
        after: list[tuple[Callable[[], None], float]] = [(self.share, 0.2), (self.advert, 0.25), (self.side, 0.35), (self.aside, 0.2), (self.talk, 0.4), (self.form, 0.2), (self.menu, 0.15), (self.notice, 0.15)]
        for f, p in before:
            if self.some(p):
                f()
        if self.some(0.5):
            self.add(f'<!-- {self.words(1, 5)} --><script>var t="</p>";track({r.randrange(99)});</script>')
        if self.some(0.97):
            self.article()
        for f, p in after:
            if self.some(p):
                f()
        if self.some(0.75):
            self.footer()
        if wrap:
            self.add("</div>")
        if self.some(0.9):
            self.add("</body></html>")
        return "".join(self.out), "\n".join(self.gold)


def labelled_page(seed: int) -> tuple[str, str]:
    """A page and the text of its article, the same for a seed everywhere."""
    return _Page(random.Random(seed)).built()
