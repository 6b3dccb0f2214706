"""Digests: parsing model answers, reconciling sources, formatting, and extractive stand-ins.

Parsers are column expressions over one answer. Stand-ins work on an array of a query's
items, struct(pos, title, url, score, content), as ``items_of`` collects them, or on what
``shown_items`` leaves of them, which is no more than the stand-in shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryspark.functions.text import WS, _col, clean_title, first_sentence, js_trim, key_point_sentence, trim_end, truncate_at_word
from quarryspark.functions.urls import clean_url, extract_urls

SOURCES = "array<struct<url:string,title:string>>"
#: fixed values: notices before raw excerpts
EXCERPT_NOTICE = "[Note: LLM synthesis unavailable; showing truncated raw content.]"
PIPELINE_NOTICE = "[Note: LLM synthesis was unavailable. The content below is raw concatenated excerpts from scraped pages.]"
EXCERPT_CHARS, EXCERPT_POINTS = 2000, 10

#: fixed values: how the lines that open a section begin, their words put together
SECTIONS = {"answer": ("answer",), "key_points": ("keypoints", "keypoint"), "sources": ("sources", "source")}
#: fixed values: what may stand between a section's name and its text in one line
DASHES = (":", "-", "–", "—")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda's argument, and not wherever it stands."""
    return F.transform(F.array(value), use)[0]


def _opened(body: Column, whole_word: bool) -> Column:
    """struct(name, rest): the section whose name ``body`` begins with, '' for none, and what follows the name."""
    spaced = F.regexp_extract(F.lower(body), r"\Akey([ \t]*)point", 1)  # "key points" may be two words

    def named(low: Column) -> Column:
        out = F.struct(F.lit("").alias("name"), F.lit("").alias("rest"))
        for section, spelt in reversed(SECTIONS.items()):
            for word in reversed(spelt):
                gap = F.length(spaced) if section == "key_points" else F.lit(0)
                fits = low.startswith(word)
                if whole_word:
                    fits = fits & ~F.substr(low, F.lit(len(word) + 1), F.lit(1)).rlike("[a-z0-9_]")
                out = F.when(fits, F.struct(F.lit(section).alias("name"), F.substr(body, len(word) + 1 + gap).alias("rest"))).otherwise(out)
        return out

    low = F.lower(body)
    return _let(F.when(spaced != "", F.concat(F.lit("key"), F.substr(low, 4 + F.length(spaced)))).otherwise(low), named)


def _heading(line: Column) -> Column:
    """As _opened, of a line of one to three number signs, white space and a section's name."""
    none = F.struct(F.lit("").alias("name"), F.lit("").alias("rest"))
    return F.when(line.rlike(f"\\A#{{1,3}}[{WS}]"), _let(js_trim(F.ltrim(line, F.lit("#"))), lambda body: _opened(body, True))).otherwise(none)


def _word(line: Column) -> Column:
    """As _opened, of a line that begins with a section's name, maybe in bold; other lines are told by one look at their start."""
    none = F.struct(F.lit("").alias("name"), F.lit("").alias("rest"))
    named = _let(F.ltrim(_unbold(F.ltrim(line, F.lit(" \t"))), F.lit(" \t")), lambda body: _opened(body, False))
    return F.when(line.rlike(r"(?i)\A[ \t]*\*{0,2}[ \t]*(?:answer|key[ \t]*point|source)"), named).otherwise(none)


def _unbold(text: Column) -> Column:
    """Without one bold or italic mark at the start."""
    return F.when(text.startswith("**"), F.substr(text, F.lit(3))).when(text.startswith("*"), F.substr(text, F.lit(2))).otherwise(text)


def _inline(rest: Column) -> Column:
    """What a line holds after a section's name, its marks left out."""
    return _let(F.ltrim(_unbold(rest), F.lit(" \t")), lambda t: js_trim(F.when(F.left(t, F.lit(1)).isin(*DASHES), F.substr(t, F.lit(2))).otherwise(t)))


def _sections(text: Column, inline: bool, blank_answer: bool) -> Column:
    """struct(answer, key_points, sources): text of each section, null where it is missing or empty; a section's first line counts. ``blank_answer``: an empty answer is ''."""
    open_line = _word if inline else _heading

    def cut(lines: Column) -> Column:
        return _let(F.transform(lines, open_line), lambda opened: _let(F.transform(opened, lambda o: o["name"]), lambda names: of_names(lines, opened, names)))

    def of_names(lines: Column, opened: Column, names: Column) -> Column:
        return _let(F.struct(*[F.array_position(names, k).cast("int").alias(k) for k in SECTIONS]), lambda at: F.struct(*[section(lines, opened, at, k).alias(k) for k in SECTIONS]))

    def section(lines: Column, opened: Column, at: Column, k: str) -> Column:
        start = at[k]
        end = F.coalesce(F.least(*[F.when(at[n] > start, at[n]) for n in SECTIONS if n != k]), F.size(lines) + 1)
        body = js_trim(F.array_join(F.slice(lines, start + 1, end - start - 1), "\n"))
        if inline:
            body = F.array_join(F.filter(F.array(_inline(F.try_element_at(opened, start)["rest"]), body), lambda s: s != ""), "\n")
        return F.when(start > 0, body if blank_answer and k == "answer" else F.nullif(body, F.lit("")))

    return _let(F.split(text, "\n"), cut)


def heading_sections(c: Column | str, blank_answer: bool = False) -> Column:
    """struct(answer, key_points, sources) by Markdown headings."""
    return _sections(_col(c), False, blank_answer)


def keyword_sections(c: Column | str, blank_answer: bool = False) -> Column:
    """struct(answer, key_points, sources) by words at the start of lines."""
    return _sections(_col(c), True, blank_answer)


def key_points(c: Column | str) -> Column:
    """Items of a bulleted or numbered list, without their marks."""
    bullet, number = f"\\A[-*•][{WS}]+", f"\\A[0-9]+[.)][{WS}]+"
    lines = F.filter(F.transform(F.split(_col(c), "\n"), js_trim), lambda x: x.rlike(bullet) | x.rlike(number))
    points = F.filter(F.transform(lines, lambda x: js_trim(F.regexp_replace(F.regexp_replace(x, bullet, ""), number, ""))), lambda x: x != "")
    return F.coalesce(points, F.array().cast("array<string>"))


def source_list(c: Column | str) -> Column:
    """URLs with titles: from the text before the line's first URL, else the last line without one, else the URL."""

    def step(acc: Column, line: Column) -> Column:
        t = js_trim(line)
        urls = extract_urls(t)
        before = clean_title(F.left(t, F.instr(t, F.try_element_at(urls, F.lit(1))) - 1))
        title = F.coalesce(F.nullif(before, F.lit("")), acc["last"])
        found = F.transform(urls, lambda u: F.struct(clean_url(u).alias("url"), F.coalesce(F.nullif(title, F.lit("")), clean_url(u)).alias("title")))
        own = clean_title(t)
        return F.struct(F.when((F.size(urls) == 0) & (own != ""), own).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], found.cast(SOURCES)).alias("out"))

    start = F.struct(F.lit("").alias("last"), F.array().cast(SOURCES).alias("out"))
    every = F.aggregate(F.split(F.coalesce(_col(c), F.lit("")), "\n"), start, step, lambda acc: acc["out"])
    return first_by_url(every)


def first_by_url(sources: Column) -> Column:
    urls = F.transform(sources, lambda s: s["url"])
    return F.filter(sources, lambda s, i: F.array_position(urls, s["url"]) == i + 1)


def parse_digest(c: Column | str, blank_answer: bool = False) -> Column:
    """struct(answer, key_points, sources): headings, else words, else the whole text is the answer.

    ``blank_answer``: a section of the answer that is there and empty is an empty answer, beside its
    points; else it counts as missing.
    """

    def parsed(text: Column, x: Column) -> Column:
        answer = F.coalesce(x["answer"], js_trim(text))
        points = F.when(x["answer"].isNull(), F.array().cast("array<string>")).otherwise(key_points(x["key_points"]))
        return F.struct(answer.alias("answer"), points.alias("key_points"), source_list(x["sources"]).alias("sources"))

    by_words = lambda text: lambda h: F.when(h["answer"].isNotNull(), h).otherwise(keyword_sections(text, blank_answer))
    return _let(_col(c), lambda text: _let(_let(heading_sections(text, blank_answer), by_words(text)), lambda x: parsed(text, x)))


def reconcile_sources(parsed: Column | str, known: Column | str) -> Column:
    """``parsed`` and after it those of ``known`` whose URL it lacks."""
    p = _col(parsed)
    return F.concat(p, F.filter(_col(known), lambda k: ~F.exists(p, lambda s: s["url"] == k["url"])))


def format_digest(answer: Column | str, points: Column | str, sources: Column | str) -> Column:
    p, s = _col(points), _col(sources)
    empty = F.array().cast("array<string>")
    listed = F.when(F.size(p) > 0, F.concat(F.array(F.lit(""), F.lit("Key Points:")), F.transform(p, lambda x: F.concat(F.lit("- "), x)))).otherwise(empty)
    cited = F.when(F.size(s) > 0, F.concat(F.array(F.lit(""), F.lit("Sources:")), F.transform(s, lambda x: F.concat(F.lit("- "), x["title"], F.lit(": "), x["url"])))).otherwise(empty)
    return F.array_join(F.concat(F.array(_col(answer)), listed, cited), "\n")


def batch_as_item(number: Column | str, digest: Column) -> Column:
    """A batch's digest (answer, sources) as a content item of the next merging round."""
    n = _col(number)
    cited = F.array_join(F.transform(digest["sources"], lambda s: F.concat(F.lit("- "), s["url"], F.lit(" ("), s["title"], F.lit(")"))), "\n")
    return F.struct(
        n.cast("long").alias("pos"), F.concat(F.lit("Digest "), (n + 1).cast("string")).alias("title"), F.concat(F.lit("digest://batch-"), (n + 1).cast("string")).alias("url"),
        F.greatest(F.lit(0.0), 1.0 - n * 0.01).alias("score"), F.concat(digest["answer"], F.lit("\n\nSources:\n"), cited).alias("content"),
    )


def items_of(items: DataFrame, key: str, pos: str) -> DataFrame:
    """One row a query: its items in order. A query's items are a search's hits, a short list."""
    return items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).cast("long").alias("pos"), "title", "url", F.col("score").cast("double").alias("score"), "content"))).alias("items"))


def shown_items(items: DataFrame, key: str, pos: str, most: int = EXCERPT_CHARS, *, titled: bool = False) -> DataFrame:
    """``items_of`` for a stand-in of at most ``most`` characters, with entries titled or not: struct(pos, title, url, score, content, point).

    Contents are measured and cut to the budget, and key points taken from them, where they
    lie; then rows are ranked, and the lengths of those before each summed up, by a window, and
    contents beyond the budget dropped before anything is gathered. So what is held of a query is a budget, its
    titles and addresses, however long its contents are.
    """
    order = Window.partitionBy(key).orderBy(-F.col("score"), "pos")
    text = F.col("content") if titled else js_trim("content")
    size = F.length(text) + (F.length("title") + F.length("url") + 5 if titled else F.lit(0))
    sentence = (key_point_sentence if titled else first_sentence)("content")
    cut = items.select(key, F.col(pos).cast("long").alias("pos"), "title", "url", F.col("score").cast("double").alias("score"), size.alias("size"), F.left(text, F.lit(most + 1)).alias("content"), sentence.alias("point"))
    used = F.sum(F.when((F.col("size") > 0) | F.lit(titled), F.col("size") + 2).otherwise(F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.select(
        key, "pos", "title", "url", "score",
        F.when(F.coalesce(used, F.lit(0)) < most, F.col("content")).otherwise(F.lit("")).alias("content"), F.when(F.row_number().over(order) <= EXCERPT_POINTS, F.col("point")).otherwise(F.lit("")).alias("point"),
    )
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "title", "url", "score", "content", "point"))).alias("items"))


def _by_score(items: Column) -> Column:
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct((-x["score"]).alias("by"), x["pos"].alias("pos"), x.alias("item")))), lambda x: x["item"])


def _concatenated(items: Column, notice: str, most: int, entry, cut, skip_blank: bool) -> Column:
    """Entries by falling score until ``most`` characters are used; the first that doesn't fit is cut."""

    def step(acc: Column, item: Column) -> Column:
        text = entry(item)
        room = F.lit(most) - acc["used"] - 2
        over = F.length(text) > room
        part = F.when(over, cut(text, room)).otherwise(text)
        use = ~acc["done"] & (room > 0) & ((F.length(text) > 0) if skip_blank else F.lit(True))
        used = F.when(use & over & F.lit(skip_blank), F.lit(most)).when(use, acc["used"] + 2 + F.length(part)).otherwise(acc["used"])
        stop = acc["done"] | (room <= 0) | (use & over & F.lit(skip_blank))
        return F.struct(used.cast("int").alias("used"), stop.alias("done"), F.when(use, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

    start = F.struct(F.lit(len(notice)).alias("used"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(_by_score(items), start, step, lambda acc: F.concat(F.lit(notice + "\n\n"), F.array_join(acc["parts"], "\n\n")))


def _sources(items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title")))


def _points(items: Column, sentence, shown: bool) -> Column:
    return F.filter(F.transform(F.slice(_by_score(items), 1, EXCERPT_POINTS), lambda x: x["point"] if shown else sentence(x["content"])), lambda s: s != "")


def excerpt_digest(items: Column | str, *, shown: bool = False) -> Column:
    """struct(answer, key_points, sources) without a model: at most 2000 characters, whole words where that costs less than half. ``shown``: the items are those of ``shown_items``."""
    a = _col(items)

    def cut(text: Column, room: Column) -> Column:
        head = F.left(text, room)
        space = F.length(head) - F.instr(F.reverse(head), " ")
        return F.when((F.instr(head, " ") > 0) & (space > room * 0.5), F.left(head, space)).otherwise(head)

    answer = _concatenated(a, EXCERPT_NOTICE, EXCERPT_CHARS, lambda x: x["content"] if shown else js_trim(x["content"]), cut, True)
    none = F.size(a) == 0
    return F.struct(F.when(none, F.lit(EXCERPT_NOTICE + " No content available.")).otherwise(answer).alias("answer"), _points(a, first_sentence, shown).alias("key_points"), _sources(a).alias("sources"))


def pipeline_excerpts(items: Column | str, most: int = 8000, *, shown: bool = False) -> Column:
    """As above with titled entries, cut hard with an ellipsis."""
    a = _col(items)
    answer = _concatenated(a, PIPELINE_NOTICE, most, lambda x: F.concat(F.lit("["), x["title"], F.lit("]("), x["url"], F.lit(")\n"), x["content"]), lambda text, room: F.concat(trim_end(F.left(text, room)), F.lit("…")), False)
    return F.struct(F.when(F.size(a) == 0, F.lit(PIPELINE_NOTICE)).otherwise(answer).alias("answer"), _points(a, key_point_sentence, shown).alias("key_points"), _sources(a).alias("sources"))


def page_excerpt(url: Column | str, title: Column | str, content: Column | str, most: int = 8000) -> Column:
    return F.concat(F.lit(PIPELINE_NOTICE + "\n\n## "), _col(title), F.lit("\nSource: "), _col(url), F.lit("\n\n"), truncate_at_word(content, most, "…"))


def is_excerpt(answer: Column | str) -> Column:
    return _col(answer).startswith(EXCERPT_NOTICE)
