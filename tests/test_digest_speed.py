"""What digests do to whole texts: ends are trimmed by a set of characters, and rows are cut where they lie."""

import re

from pyspark.sql import functions as F

from quarryspark.functions import text as T
from quarryspark.operators import digest

ODD = ["", " ", " ﻿", "a", " a. b ", "a.b", "a. b. c", ".", ". a", "no end", "\n x . y　", "a.\n", "é.", "𝒳. y", "​z. ​", "a . b.c", "...", "x. y"]


def _plan(d):
    d.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return d._jdf.queryExecution().executedPlan().toString()


def test_trimming_takes_no_pattern(spark, values):
    plan = _plan(spark.createDataFrame([("a",)], "x string").select(T.js_trim("x"), T.trim_end("x")))
    assert "regexp" not in plan and "trim" in plan
    assert values(T.js_trim, ODD) == [re.sub(f"\\A[{T.WS}]+|[{T.WS}]+\\Z", "", x) for x in ODD]
    assert values(T.trim_end, ODD) == [re.sub(f"[{T.WS}]+\\Z", "", x) for x in ODD]
    assert len(T.WHITE) == 25 and all(re.fullmatch(f"[{T.WS}]", c) for c in T.WHITE)


def test_first_sentences_as_by_the_pattern(values):
    trim = lambda x: re.sub(f"\\A[{T.WS}]+|[{T.WS}]+\\Z", "", x)
    period = lambda x: (re.match(f"(?s)([^.]*\\.)(?:[{T.WS}].*)?\\Z", trim(x)) or ["", ""])[1]
    assert values(T.first_sentence, ODD) == [period(x) or trim(x) for x in ODD]
    assert values(lambda c: T.key_point_sentence(c, 3), [*ODD, None]) == [*[period(x) or trim(x)[:3] for x in ODD], None]


def test_contents_are_cut_before_they_are_dealt(spark):
    rows = [(1, k, f"t{k}", f"u{k}", k / 10, f" s{k}. " + "x" * 3000) for k in range(4)]
    items = spark.createDataFrame(rows, "query_id int, rank int, title string, url string, score double, content string")
    for titled in (False, True):
        shown = digest.shown_items(items, "query_id", "rank", titled=titled)
        assert ", 2001)" in _plan(shown).rsplit("Exchange", 1)[1]
        got = shown.select(F.inline("items")).orderBy("pos").collect()
        assert [r.point for r in got] == ["s0.", "s1.", "s2.", "s3."] and [len(r.content) for r in got] == [0, 0, 0, 2001]
