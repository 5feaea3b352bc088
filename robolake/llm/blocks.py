"""Web pages as leaf blocks: stretches of text between block-level tags, with the tags and names around them.

A page is read once from left to right. Scripts, styles, titles, comments and the like give no text; broken markup is taken as browsers do for the
cases that are common: unclosed paragraphs, list items and table cells end where the next begins, an end tag without a start is ignored, and an
unclosed script, comment or quotation reaches as far as it can. Time and memory are in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter

#: Tags that end a block of text. Fixed values of HTML.
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3
    h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody
    td template textarea tfoot th thead tr ul video audio canvas svg""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("iframe noembed noframes plaintext script style svg template textarea title xmp canvas audio video object math".split())
#: A start tag ends these open ones, up to the container named.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
#: Tags that say what a part of the page is.
PARTS = frozenset("article aside main nav header footer form section dialog figure table blockquote button select noscript body".split())
INSIDE_P = BLOCK - {"button", "iframe", "noscript", "object", "select", "option", "optgroup", "textarea", "video", "audio", "canvas", "svg", "template"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[>\"']")


class Block:
    """One stretch of text: its text, innermost tags, the innermost tag that says what a part is, all tags and names around it, the names of the innermost
    element that has any, how many letters are in links, and which element holds it."""

    __slots__ = ("holder", "linked", "names", "near", "part", "tag", "tags", "text", "up")

    def __init__(self, text: str, tag: str, up: str, part: str, near: list[str], tags: Counter, names: list[str], linked: float, holder: int):
        self.text, self.tag, self.up, self.part, self.near, self.tags, self.names, self.linked, self.holder = text, tag, up, part, near, tags, names, linked, holder


def _names(attributes: str) -> list[str]:
    """The words of a tag's class, id and role, and ``hidden`` if it isn't shown."""
    out = []
    if "=" in attributes:
        for value in _ATTRIBUTE.findall(attributes):
            out += [p.lower() for p in _PART.findall("".join(value))]
    if "hidden" in attributes or "display" in attributes and "display:none" in attributes.replace(" ", ""):
        out.append("hidden")
    return list(dict.fromkeys(out))


class _Reader:
    def __init__(self, page: str, known: frozenset[str] | None):
        self.page, self.known = page, known
        self.stack: list[tuple[str, list[str]]] = []  # tag, names
        self.held: list[tuple[str, int, str, list[str]]] = [("body", 0, "body", [])]  # the block-level ones: tag, number of the element, part, nearest names
        self.tags: Counter = Counter()
        self.names: Counter = Counter()
        self.pieces: list[tuple[str, bool]] = []
        self.blocks: list[Block] = []
        self.elements = 0

    def flush(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(t for t, _ in self.pieces).split())
        if text:
            linked = sum(len(t) - t.count(" ") for t, a in self.pieces if a) / max(1, sum(len(t) - t.count(" ") for t, _ in self.pieces))
            tag, holder, part, near = self.held[-1]
            up = self.held[-2] if len(self.held) > 1 else self.held[0]
            self.blocks.append(Block(text, tag, up[0], part, near, self.tags.copy(), list(self.names), linked, up[1] if tag in ("p", "li") else holder))
        self.pieces = []

    def push(self, tag: str, attributes: str) -> None:
        names = [n for n in _names(attributes) if self.known is None or n in self.known] if tag in BLOCK or tag == "a" else []
        self.elements += 1
        self.stack.append((tag, names))
        if tag in BLOCK:
            _, _, part, near = self.held[-1]
            self.held.append((tag, self.elements, tag if tag in PARTS else part, names or near))
        self.tags[tag] += 1
        self.names.update(names)

    def pop(self) -> str:
        tag, names = self.stack.pop()
        if tag in BLOCK:
            self.held.pop()
        for counts, keys in ((self.tags, (tag,)), (self.names, names)):
            for k in keys:
                counts[k] -= 1
                if not counts[k]:
                    del counts[k]
        return tag

    def close(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """End the innermost open one of tags, unless one of within lies inside it."""
        if not any(self.tags[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            t = self.stack[k][0]
            if t in tags:
                del_to = k
                break
            if t in within:
                return
        while len(self.stack) > del_to:
            self.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            if tag in INSIDE_P and self.tags["p"]:
                self.close(("p",), ("button", "table", "td", "th", "caption") if tag == "p" or tag != "table" else ("button",))
            if tag in ENDS:
                self.close(*ENDS[tag])
        elif tag == "br":
            self.pieces.append((" ", False))
        elif tag == "a":
            self.close(("a",), tuple(BLOCK))
        if tag not in VOID:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
            self.close((tag,), ("td", "th", "table") if tag == "p" else ())
        elif self.tags[tag]:
            self.close((tag,), tuple(BLOCK))

    def read(self) -> list[Block]:
        page, n, at = self.page, len(self.page), 0
        lower = None
        lost: set[str] = set()  # quotation marks that don't come again
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.pieces.append((html.unescape(page[at:lt]), bool(self.tags["a"])))
            if lt == n:
                break
            mark = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            elif mark in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            elif name := _NAME.match(page, lt + 1 + (mark == "/")):
                at, stop = name.end(), n
                while m := _STOP.search(page, at):  # the end of the tag, not one in a quotation
                    q = m.group()
                    stop = m.start()
                    if q == ">":
                        break
                    far = -1 if q in lost else page.find(q, stop + 1)
                    if far < 0:
                        lost.add(q)
                        at = stop + 1
                    else:
                        at = far + 1
                else:
                    stop = n
                tag = name.group().lower()
                attributes = page[name.end() : stop]
                at = stop + 1
                if mark == "/":
                    self.end(tag)
                elif tag in RAW and not attributes.endswith("/"):
                    if tag in BLOCK:
                        self.flush()
                    if lower is None:
                        lower = page.lower() if len(page.lower()) == n else page
                    end = lower.find(f"</{tag}", at)
                    close = -1 if end < 0 else page.find(">", end)
                    at = n if close < 0 else close + 1
                else:
                    self.start(tag, attributes)
            else:
                self.pieces.append(("<", bool(self.tags["a"])))
                at = lt + 1
        self.flush()
        return self.blocks


def leaf_blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The blocks of a page in order, none without text; of names around them those in known, else all. Null is empty."""
    return _Reader(page or "", known).read()


_SIZES = (1, 2, 3, 6, 12, 25, 50, 100)
_ENDS = tuple(".!?…。:;\"”»)")


def _bucket(n: float, bounds: tuple) -> int:
    return sum(n > b for b in bounds)


def own_features(b: Block) -> tuple[list[str], str]:
    """What a block shows by itself, and the short form of it that its neighbours see."""
    words = b.text.count(" ") + 1
    size, link = _bucket(words, _SIZES), _bucket(b.linked, (0, 0.2, 0.5, 0.9))
    ends = "e" if b.text.endswith(_ENDS) else "n"
    commas = _bucket(b.text.count(",") + b.text.count("，"), (0, 1, 3))
    out = [f"tag {b.tag}", f"up {b.up}", f"size {size}", f"link {link}", f"ends {ends}", f"commas {commas}", f"tag {b.tag} link {link}", f"size {size} ends {ends}"]
    out += [f"in {t}" for t in b.tags if t in BLOCK]
    out += [f"name {n}" for n in b.names]
    out += [f"near {n}" for n in b.near]
    out += [f"part {b.part}", f"part {b.part} tag {b.tag}"]
    if b.tags["article"] > 1:
        out.append("articles")
    if not b.names:
        out.append(f"no name {b.tag}")
    if "©" in b.text or "|" in b.text or "·" in b.text or "»" in b.text:
        out.append("signs")
    return out, f"{b.tag} {min(size, 5)} {link} {'n' if b.names else ''}"


def features(blocks: list[Block]) -> list[list[str]]:
    """For each block its own features, its neighbours' short forms and its place."""
    own = [own_features(b) for b in blocks]
    n, out = len(blocks), []
    for k, (f, _) in enumerate(own):
        before = own[k - 1][1] if k else "none"
        after = own[k + 1][1] if k + 1 < n else "none"
        out.append([*f, f"before {before}", f"after {after}", f"place {4 * k // n}", "bias"])
    return out


def edges(blocks: list[Block]) -> list[int]:
    """For each block but the first whether it lies in the same element as the one before."""
    return [int(a.holder == b.holder) for a, b in zip(blocks, blocks[1:], strict=False)]
