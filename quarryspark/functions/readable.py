"""The readable part of a page, by scores on its element tree.

A page is read into flat lists of elements and texts in document order, whatever its tags
are like: closing tags end what they match, ends that are left out are implied. Then

1. a block, an element that itself holds text, earns points for its characters outside links;
2. points are passed on: a paragraph's to its parent in full, to the ancestors above in falling
   shares, at most REACH levels and not out of asides: navigation, headers, footers, forms, and
   what its class or id calls an advert, a menu, comments and the like;
3. an element's score is its points less the share of its text that is links, little for asides
   and more for article and main; the best one is the content. An article or main part around
   it that is content too stands for it, as it holds the headings as well;
4. siblings of the best element that are like it, by score or as plain paragraphs, join it.

Where a page has an article or main part outside of asides, no aside is its content, however
short that part is: a page whose article is empty has no text.

The text is that of the chosen elements without scripts, styles and the asides in them, nor
lists of links, a line for each block. Work is linear in the page, however its tags nest.
"""

from __future__ import annotations

import re
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

SKIPPED = frozenset("script style noscript template svg iframe".split())
ASIDE = frozenset("nav header footer aside form".split())
BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 table tbody thead tr td th section article main pre blockquote figure figcaption dl dt dd hr address details summary body html fieldset center".split()) | ASIDE
#: words of a class or id that say the same of any element but these
AWAY = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie menu nav navbar newsletter promo related share sharing sidebar social sponsor sponsored subscribe widget".split())
CONTENT = {"article": 3.0, "main": 2.0, "body": 1.0, "html": 1.0, "[page]": 1.0}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose own text is theirs and not their parent's
HOLDERS = frozenset("div td th section article main body html center [page]".split()) | ASIDE
#: what an opening tag ends, and what it doesn't look beyond
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: levels that points are passed on, and the share of an ancestor as far away
REACH = 4
SHARES = (1.0, 0.5, 0.3, 0.2)
#: characters of a block from which on its points count in full
FULL_CHARS = 25
#: links of a list, and the share of its text in them, that make it a list of links
MANY_LINKS, MOSTLY_LINKS = 3, 0.6


class _Tree(HTMLParser):
    """Elements by number in document order, with tag, parent and ``end``, one past the last inside.

    ``seen`` holds a pair for each edge of an element, (element, None), and each text, (element,
    text); ``span`` the pairs of each element.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.end, self.aside = ["[page]"], [-1], [0], [False]
        self.open, self.counts = [0], Counter()  # how many of each tag are open
        self.seen: list[tuple[int, str | None]] = []
        self.span: list[list[int]] = [[0, 0]]

    def _close(self, depth: int) -> None:
        for n in reversed(self.open[depth:]):
            self.seen.append((n, None))
            self.counts[self.tag[n]] -= 1
            self.end[n], self.span[n][1] = len(self.tag), len(self.seen)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS and tag != "br":  # a block ends an open paragraph
            self._imply({"p"}, HOLDERS | {"li", "blockquote", "dd"})
        if tag in ENDS:
            self._imply(*ENDS[tag])
        said = " ".join(v for name, v in attrs if name in ("class", "id", "role") and v)
        self.aside.append(tag in ASIDE or tag not in CONTENT and not AWAY.isdisjoint(re.findall(r"[a-z]+", said.lower())))
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.end.append(len(self.tag))
        self.span.append([len(self.seen), len(self.seen) + 1])
        self.seen.append((len(self.tag) - 1, None))
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)
            self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "iframe") and self.tag[self.open[-1]] == tag:
            self._close(len(self.open) - 1)

    def _imply(self, ended: set[str], within: set[str] | frozenset[str]) -> None:
        if not any(self.counts[t] for t in ended):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[depth]]
            if t in ended:
                self._close(depth)
                return
            if t in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in ("body", "html") or not self.counts[tag]:  # what comes after a body is still the page's
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                self._close(depth)
                return
            if tag not in HOLDERS and tag not in SKIPPED and self.tag[self.open[depth]] in ("td", "th", "table"):
                return  # an end in a cell ends nothing outside it

    def handle_data(self, data: str) -> None:
        self.seen.append((self.open[-1], data))

    def read(self, page: str) -> _Tree:
        self.feed(page)
        self.close()
        self._close(0)
        return self


def _chars(text: str) -> int:
    return len("".join(text.split()))


class _Page:
    def __init__(self, page: str):
        t = _Tree().read(page)
        self.tag, self.parent, self.end, self.aside, self.seen, self.span = t.tag, t.parent, t.end, t.aside, t.seen, t.span
        n = len(self.tag)
        self.hidden, self.in_link, self.in_aside, self.block = [False] * n, [False] * n, [False] * n, [0] * n
        self.title, self.heading = [], []
        for k in range(n):
            up, tag = self.parent[k], self.tag[k]
            self.hidden[k] = k > 0 and (self.hidden[up] or tag in SKIPPED or tag in ("title", "select", "textarea", "button"))
            self.in_link[k] = k > 0 and (self.in_link[up] or tag == "a")
            self.in_aside[k] = self.aside[k] or k > 0 and self.in_aside[up]
            self.block[k] = k if k == 0 or tag in BLOCKS else self.block[up]
        own, own_links, self.chars, self.links, self.anchors = [0] * n, [0] * n, [0] * n, [0] * n, [int(t == "a") for t in self.tag]
        for at, text in self.seen:
            if text is None:
                continue
            names = {"title": self.title, "h1": self.heading}.get(self.tag[at])
            if names is not None:
                names.append(text)
            if not self.hidden[at]:
                c = _chars(text)
                own[self.block[at]] += c
                self.chars[at] += c
                if self.in_link[at]:
                    own_links[self.block[at]] += c
                    self.links[at] += c
        for k in range(n - 1, 0, -1):
            for sums in (self.chars, self.links, self.anchors):
                sums[self.parent[k]] += sums[k]
        self.plain = [c - link for c, link in zip(own, own_links, strict=True)]
        self.points = [0.0] * n
        for k in range(n):
            if self.plain[k] > 0:
                self._pass_on(k, self.plain[k] if self.plain[k] >= FULL_CHARS else self.plain[k] / 4)

    def _pass_on(self, k: int, points: float) -> None:
        to = k if self.tag[k] in HOLDERS or k == 0 else self.parent[k]
        for share in SHARES[:REACH]:
            self.points[to] += points * share
            if to == 0 or self.aside[to]:
                return
            to = self.parent[to]

    def _outermost(self, found: list[int]) -> list[int]:
        out: list[int] = []
        for k in found:
            if not out or k >= self.end[out[-1]]:
                out.append(k)
        return out

    def density(self, k: int) -> float:
        return self.links[k] / self.chars[k] if self.chars[k] else 0.0

    def score(self, k: int) -> float:
        plain = 1 - self.density(k)
        return self.points[k] * plain * (0.2 * plain if self.aside[k] else CONTENT.get(self.tag[k], 1.0))

    def chosen(self) -> list[int]:
        """The elements whose text is the content, in order."""
        named = [k for k, tag in enumerate(self.tag) if tag in ("article", "main") and not self.in_aside[k] and not self.hidden[k]]
        best = max((k for k in range(len(self.tag)) if not (named and self.in_aside[k])), key=lambda k: (self.score(k), -k))
        top = self.score(best)
        if not top:
            return self._outermost(named) or [0]
        k = best
        while k > 0 and self.tag[k] not in ("article", "main"):
            k = self.parent[k]
        if k > 0 and self.score(k) >= top / 8:
            best = k
        if best == 0 or self.tag[best] in ("main", "body", "html", "td", "th"):
            return [best]
        out = []
        k = self.parent[best] + 1
        while k < self.end[self.parent[best]]:
            like = self.score(k) >= 0.25 * top and not self.aside[k]
            paragraph = self.tag[k] == "p" and self.chars[k] >= 80 and self.density(k) < 0.25
            if k == best or like or paragraph and not self.aside[k]:
                out.append(k)
            k = self.end[k]
        return out

    def text(self, k: int) -> str:
        """An element's text, line breaks around blocks."""
        drop = [False] * (self.end[k] - k)
        for n in range(k + 1, self.end[k]):
            list_of_links = self.tag[n] in ("ul", "ol", "dl", "div", "table") and self.anchors[n] >= MANY_LINKS and self.density(n) >= MOSTLY_LINKS
            menu = self.tag[n] == "a" and self.block[n] == k and self.aside[k]
            drop[n - k] = drop[self.parent[n] - k] or self.hidden[n] or self.aside[n] or list_of_links or menu
        out = []
        for n, text in self.seen[slice(*self.span[k])]:
            if text is None:
                out.append("\n" if self.tag[n] in BLOCKS else "")
            elif not drop[n - k]:
                out.append(text)
        return "".join(out)


def only_closed_references(page: str) -> str:
    """``page`` with every ``&`` escaped that begins no character reference with a semicolon at its end."""
    closed = lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or "")
    return re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", closed, page)


def readable(page: str | None, open_references: bool = True) -> tuple[str, str]:
    """(title, text) of a page; '' for what it lacks. Nothing is cut off and no page is too odd to be read.

    References that lack their semicolon (``&amp`` and then a tag) are decoded as browsers do, or
    without ``open_references`` left as they are written.
    """
    p = _Page((page or "") if open_references else only_closed_references(page or ""))
    lines = (" ".join(line.split()) for k in p.chosen() for line in [*p.text(k).split("\n"), ""])
    return " ".join("".join(p.title or p.heading).split()), "\n".join(x for x in lines if x)
