"""The pipeline and its stages against brute-force versions; columns of any name, nulls, repeats, empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryspark.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGES = dict(corpus_pipeline.STAGES)
#: names that stages and operators use themselves
CLASHES = ["score", "lang_pred", "ambiguous", "n_words", "n_removed", "kept_text", "kept_sha256", "row", "key", "size", "epochs", "partial", "words", "_size", "_id", "_nth", "_gone", "gone", "id", "component_id", "kept", "n_shingles", "_key", "bucket", "of", "target", "tie", "unit", "entries", "piece", "start", "length", "sequence_id", "a b.c`d"]


def _clean(r, k):
    return " ".join(r.choice("the and thing ereand thion bleing of".split()) + str(k % 7 == 0 or "") for k in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    clean = _clean(random.Random(1), 0)
    more = [(9000, None, "en", "src0", 0), (9001, "", "en", None, 0), (9002, "12 34 !!", "en", "src1", 8), (None, "the and of thing " * 4, "en", "src2", 68), (None, "the and of thing " * 4, "en", "src2", 68)]
    more += [(9003 + k, clean, "en", "src2", len(clean)) for k in range(3)]
    return d.unionByName(spark.createDataFrame(more, d.schema))


def _near(rows, k=5, percent=80):
    """Ids of the rows that stay, by comparing all pairs."""
    sets = []
    for x in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x.text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = {x.doc_id: x.doc_id for x in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and None not in (rows[a].doc_id, rows[b].doc_id) and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(rows[a].doc_id), find(rows[b].doc_id)
                parent[max(x, y)] = min(x, y)
    return [x.doc_id for x in rows if x.doc_id is None or find(x.doc_id) == x.doc_id]


def _without_repeats(rows, n=35):
    w = [WORD.findall(x.text or "") for x in rows]
    c = collections.Counter(tuple(x[i : i + n]) for x in w for i in range(len(x) - n + 1))
    out = []
    for row, x in zip(rows, w, strict=True):
        gone = {j for i in range(len(x) - n + 1) if c[tuple(x[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((row.doc_id, " ".join(y for i, y in enumerate(x) if i not in gone) if gone else row.text))
    return out


def _mixed(rows):
    """Copies and texts by the definition: order by key, whole epochs, a cut at the budget."""
    size = collections.Counter()
    for x in rows:
        size[x.source] += len(WORD.findall(x.text or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, target, open_ = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    while open_:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        target |= {s: 3 * size[s] for s in over} or share
        open_ -= set(over or open_)
    out = []
    for s in names:
        budget = round(target[s])
        key = lambda x: hashlib.md5(f"mix:{x.doc_id if x.doc_id is not None else 'text:' + hashlib.md5((x.text or '').encode()).hexdigest()}".encode()).hexdigest()
        mine = sorted((x for x in rows if x.source == s), key=key)
        while budget > 0:
            for x in mine:
                w = WORD.findall(x.text or "")
                if w and budget > 0:
                    out.append((x.doc_id, x.text if budget >= len(w) else " ".join(w[:budget])))
                budget -= len(w)
    return out


def test_stages_against_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, key = spark.read.parquet(str(tmp_path / "documents.parquet")), lambda r: tuple(map(repr, r))
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
        if name == "language":
            ids = {x.doc_id for x in after}
            assert not ids & {9000, 9001, 9002} and len(after) >= len(before) - 6
        elif name == "near_dedup":
            assert sorted(x.doc_id or -1 for x in after) == sorted(i or -1 for i in _near(before))
        elif name == "substring_dedup":
            assert sorted(((x.doc_id, x.text) for x in after), key=key) == sorted(_without_repeats(before), key=key)
            assert all(x.n_chars == len(x.text) for x in after)
        elif name == "mixing":
            assert sorted(((x.doc_id, x.text) for x in after), key=key) == sorted(_mixed(before), key=key)
        else:
            import public_tokenizers as P
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            want = sum(len(t.encode(x.text or "", add_special_tokens=False).ids) + 1 for x in before)
            assert sum(x.length for x in after) == want
            room = collections.defaultdict(list)
            for x in after:
                room[x.sequence_id].append((x.offset, x.length))
            for spans in room.values():
                spans.sort()
                assert [o for o, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist() and sum(n for _, n in spans) <= 2048
            assert len(room) <= after[0].overall_bound + 2
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.count() == now.count() and again.agg(F.sum("ids_crc32")).first() == now.agg(F.sum("ids_crc32")).first()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_cases(spark, docs, name):
    stage = STAGES[name]
    small = docs.filter("doc_id < 40 or doc_id >= 9000 or doc_id is null")
    some = small.select(*small.columns, *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    plain, wide = stage(spark, small, SF), stage(spark, some, SF)
    if name == "packing":
        assert wide.columns == plain.columns and wide.count() == plain.count()
    else:
        assert wide.columns == some.columns
        rows = wide.collect()
        assert all(x[c] == (None if x.doc_id is None else f"{c}:{x.doc_id}") for x in rows for c in CLASHES)
        assert sorted(map(repr, wide.select(*small.columns).collect())) == sorted(map(repr, plain.collect()))
    assert stage(spark, some.limit(0), SF).count() == 0
    nulls = stage(spark, small.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema]), SF)
    assert nulls.count() == {"mixing": 0}.get(name, 3)
    unlabelled = stage(spark, small.withColumn("lang", F.lit(None).cast("string")), SF).count()
    assert unlabelled == small.count() if name == "language" else unlabelled > 0


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_mixing_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op8_mixing"](spark, SF)
    want = con.execute(queries.ORACLE_SQL["op8_mixing"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
