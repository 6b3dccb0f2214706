"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page becomes a sequence of tokens: runs of words and tags. Words score by the container
they stand in, tags score negative by their name. What a container is follows from its
element name and the words of its class, id and role: each is evidence in log-odds, from
counts of labelled pages (those that mark their content themselves with <article> or <main>)
on top of a prior worth a few pages; the fixed lists below are priors only. Evidence of -1 or
less makes a container no content, of 1 or more content, and one in between belongs to what
is around it. One linear scan (Kadane's) finds the contiguous region of highest score;
inside it, words in containers that are no content (an aside in the article, reader
comments) are left out; those inside content weigh next to nothing, so they don't part the
region.

Text is put out as blocks: character references decoded, white space inside a block made
one space, blocks joined by one newline in page order. Nothing is cut off, and all steps
take time in proportion to the page.

Cases: null, empty and text-less pages give empty text; unclosed elements end with the
container around them, an unclosed script or comment with the page; a head without a closing
tag ends at the first body, other flow element or text; a self-closed svg or math is empty;
pages of any length are parsed whole; repeated rows are extracted alike; where no page is
labelled the priors stand alone; columns that clash with ``text`` or ``n_chars`` are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.runtime import extended, other_columns, quoted

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
#: what a head holds, item by item
_HEAD_ITEMS = "|".join(
    [r"\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*>", rf"</?(?:meta|link|base|basefont|bgsound)\b{_ATTRIBUTES}>"]
    + [rf"<{n}\b{_ATTRIBUTES}>.*?(?:</{n}\s*>|\Z)" for n in ("title", "script", "style", "noscript", "template", "noframes")]
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    rf"|(?P<head><head(?=[\s/>]){_ATTRIBUTES}>(?:(?:{_HEAD_ITEMS})*+</head\s*>|(?:(?!<(?:body|head)[\s/>]).)*?</head\s*>|(?:{_HEAD_ITEMS})*+))"
    rf"|(?!<(?:svg|math)\b{_ATTRIBUTES}/>)<(?P<raw>script|style|noscript|template|iframe|textarea|select|svg|math|object|button|canvas|audio|video)\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: elements that can hold a part of a page
CONTAINERS = frozenset("article main section nav header footer aside form div ul ol dl table figure details dialog fieldset menu body".split())
#: elements within a line; any other starts a new block
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: priors: names of containers that are no content, and words of classes and ids that say so
OUTSIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
SAYS_OUTSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies disqus discussion footer form gdpr header links login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toc toolbar topbar warning widget widgets".split()
)
SAYS_INSIDE = frozenset("article articlebody body content entry main mainbody post story text".split())
#: words of classes that say where things stand, not what they are
SAYS_NOTHING = frozenset("area bar block box col column container group holder inner item items layout list outer page panel row section site slot unit wrap wrapper zone".split())
#: log-odds of a prior, and how many pages it is worth
PRIOR, PRIOR_PAGES = 2.0, 4.0
#: weight of words that stand nowhere in particular
PLAIN = 0.5


def prior(what: str) -> float:
    """Of an element name ("<nav") or a word of a class."""
    if what.startswith("<"):
        return -PRIOR if what[1:] in OUTSIDE else PRIOR if what[1:] in ("article", "main") else 0.0
    return -PRIOR if what in SAYS_OUTSIDE else PRIOR if what in SAYS_INSIDE else 0.0


class Container(NamedTuple):
    """Where text stands: its weight a word, whether it is left out inside content, what speaks for it and for what is around it."""

    name: str
    weight: float
    within: bool
    signs: tuple[str, ...]
    around: tuple[str, ...] = ()


@dataclass
class PageWeights:
    """Learned log-odds of signs, and scores of tags by name."""

    signs: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    known: dict[tuple[str, str], tuple[float, float, tuple[str, ...]]] = field(default_factory=dict, repr=False)

    def sign(self, what: str) -> float:
        v = self.signs.get(what)
        return prior(what) if v is None else v

    def _named(self, words: list[str], skip: str = "") -> float:
        """Evidence of one class name: the mean of its words', where words for content yield to those against."""
        values = [self.sign(w) for w in words if w not in SAYS_NOTHING and w != skip]
        if any(v < 0 for v in values):
            values = [min(v, 0.0) for v in values]
        return sum(values) / len(values) if values else 0.0

    def evidence(self, name: str, rest: str) -> tuple[float, float, tuple[str, ...]]:
        """(evidence, evidence inside content, signs) of a container; a header inside content may be its head."""
        found = self.known.get((name, rest))
        if found is None:
            # div, ul and their like say nothing themselves, wherever labelled pages have them
            signs = ["<" + name] if prior("<" + name) else []
            own = self.sign(signs[0]) if signs else 0.0
            names = [[w.lower() for w in _PARTS.findall(n)] for m in _NAMED.finditer(rest) for n in (m[1] or m[2] or m[3] or "").split()] if rest else []
            outer, inner = [own], [own]
            for words in names:
                outer.append(self._named(words))
                inner.append(self._named(words, "header"))
                signs += words
            total = lambda v: min(v) if min(v) <= -1 else max(v)
            found = (-3.0, -3.0, ("hidden",)) if rest and _HIDDEN.search(rest) else (total(outer), total(inner), tuple(dict.fromkeys(signs)))
            if len(self.known) < 10_000:
                self.known[name, rest] = found
        return found

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.05 if name in INLINE or name in ("p", "h1", "h2", "h3") else -0.25)


def tokens(page: str, weights: PageWeights) -> Iterator[tuple[str, str, Container]]:
    """(kind, what, container): kind "t" is text, "o" an opening and "c" a closing tag."""
    here = body = Container("body", PLAIN, False, ())
    stack: list[Container] = []
    open_: Counter = Counter()  # elements on the stack by name
    content: list[Container] = []  # those that are content
    heading = ""
    for m in _TOKEN.finditer(page):
        text, name, close, rest, raw, head = m.group("text", "name", "close", "rest", "raw", "head")
        if text is not None:
            yield "t", text, content[-1] if heading and content and here.name == "header" else here
        elif name:
            name = name.lower()
            if close:
                if name == heading:
                    heading = ""
                if open_[name]:
                    while True:
                        gone = stack.pop()
                        open_[gone.name] -= 1
                        if content and content[-1] is gone:
                            content.pop()
                        if gone.name == name:
                            break
                    here = stack[-1] if stack else body
                yield "c", name, here
            else:
                if name in CONTAINERS and name != "body" and not (rest and rest.rstrip().endswith("/")):
                    outer, inner, signs = weights.evidence(name, rest)
                    e = inner if content else outer
                    if e <= -1:
                        here = Container(name, max(-3.0, e), bool(content), signs)
                    elif e >= 1 and (here.weight > 0 or name in ("article", "main")):
                        here = Container(name, min(3.0, e), False, signs)
                        content.append(here)
                    else:  # belongs to what is around it
                        here = Container(name, here.weight, here.within, signs, here.around or here.signs)
                    stack.append(here)
                    open_[name] += 1
                elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
                    heading = name
                yield "o", name, here
        elif raw or head:
            yield "o", (raw or "head").lower(), here


def count_page(page: str, counts: Counter) -> bool:
    """Add what a labelled page says of signs (once a page and side) and tags; False if the page isn't labelled.

    Text inside the marked content counts for its container; a quarter only where the priors
    call that container no content, as such things do stand inside articles.
    """
    depth, here, labelled = 0, Counter(), False
    for kind, what, box in tokens(page, PageWeights()):
        if kind != "t" and what in ("article", "main"):
            labelled = True
            depth = max(0, depth + (1 if kind == "o" else -1))
        elif kind != "t":
            here["tag", what, depth > 0 and box.weight > 0] += 1
        elif not what.isspace():
            for sign in {*box.signs, *box.around}:
                k = ("sign", sign, depth > 0)
                here[k] = max(here[k], 1 if depth == 0 or box.weight > 0 else 0.25)
    if labelled:
        counts.update(here)
    return labelled


def weights_of(counts: Counter) -> PageWeights:
    """Log-odds of signs on top of their priors, between -3 and 3; of tags, smoothed, between -1 and -0.05."""
    out = PageWeights()
    total = {side: 1 + sum(v for (k, _, s), v in counts.items() if k == "tag" and s == side) for side in (True, False)}
    for kind, key in {(k, n) for k, n, _ in counts}:
        inside, outside = counts[kind, key, True], counts[kind, key, False]
        if kind == "sign":
            share = 1 / (1 + math.exp(-prior(key)))
            out.signs[key] = max(-3.0, min(3.0, math.log((inside + PRIOR_PAGES * share) / (outside + PRIOR_PAGES * (1 - share)))))
        else:
            out.tags[key] = max(-1.0, min(-0.05, math.log((inside + 0.5) / total[True] * total[False] / (outside + 0.5))))
    return out


def main_text(page: str | None, weights: PageWeights) -> str:
    """The blocks of the highest-scoring region, one a line."""
    if not page:
        return ""
    seq = list(tokens(page, weights))
    best = run = 0.0
    begin = lo = hi = 0
    for k, (kind, what, box) in enumerate(seq):
        if run <= 0:
            run, begin = 0.0, k
        if box.within:
            run -= 1e-9
        elif kind == "t":
            run += box.weight * len(what.split())
        else:
            run += weights.tag(what)
        if run > best:
            best, lo, hi = run, begin, k + 1
    blocks, line = [], []
    for kind, what, box in seq[lo:hi]:
        if kind == "t":
            if box.weight > 0:
                line.append(what)
        elif what == "br":
            line.append(" ")
        elif what not in INLINE:
            blocks.append("".join(line))
            line = []
    blocks.append("".join(line))
    cleaned = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


def learn_weights(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", sample_rows: int = 4000) -> PageWeights:
    """From the labelled pages among about ``sample_rows`` pages, chosen by a hash of id and page, so that null and repeated ids make no difference."""
    n = pages.count()
    spot = F.pmod(F.xxhash64(F.lit("pages"), F.col(id_col).cast("string"), F.col(html_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = pages.filter(spot < min(1.0, sample_rows / max(1, n))).select(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                count_page(page or "", counts)
        rows = [(*k, v) for k, v in counts.items()]
        yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(("kind", "name", "inside", "n"))}, schema=pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.float64())]))

    # as many rows as there are tag names and words of classes in the sample
    rows = chosen.mapInArrow(run, "kind string, name string, inside boolean, n double").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of(Counter({(r["kind"], r["name"], r["inside"]): r["n"] for r in rows}))


def extract_main_text(pages: DataFrame, weights: PageWeights, *, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars."""
    names = other_columns(pages, ["text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, weights) for p in b.column(b.schema.get_field_index(html_col)).to_pylist()]
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.mapInArrow(run, extended(pages.select(*quoted(names)).schema, "text string, n_chars long"))
