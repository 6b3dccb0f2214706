"""Hard negatives, license scans and whitening against brute force and SQL; nulls, empties, ties, repeats, clashes."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryspark.llm import hard_negatives, license_scan, queries, whitening
from quarryspark.llm.license_scan import Template, scan_licenses

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"


def by_sql(name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(queries.ORACLE_SQL[name]).df()


# --- 11 hard negatives


def negatives_by_force(rows, anchors, positives=5, negatives=10, low=30, high=90):
    good = [(i, v, lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in good]
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1)
    out = []
    for k, (i, _, lab) in enumerate(good):
        if i is None or not anchors(i):
            continue
        scored = sorted(((-dot(whole[k], w), j is None, j or 0, n) for n, (w, (j, _, _)) in enumerate(zip(whole, good, strict=True))))
        for s, none, j, _ in [x for x in scored if x[3] != k and good[x[3]][2] == lab][:positives]:
            near = [x for x in scored if good[x[3]][2] != lab and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, None if none else j, r + 1, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(near)]
    return sorted(out, key=repr)


def mined(spark, rows, schema=VECTORS, **more):
    return sorted((tuple(r) for r in hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 3 == 0, **more).collect()), key=repr)


def test_hard_negatives_like_brute_force(spark):
    r = random.Random(5)
    rows = [(k, [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(6)], r.randrange(3)) for k in range(60)]
    rows += [rows[3], rows[3], (9, [1.0] * 6, 1), (None, [0.5] * 6, 0), (None, [0.5] * 6, 1), (61, None, 1), (63, [1.0] * 6, None), (66, [None] + [1.0] * 5, 1), (69, [float("nan")] * 6, 1), (72, [float("inf")] * 6, 1)]
    rows += [(75, [0.5, 0.5], 2), (78, [], 2), (79, [1.0] * 9, 0)]
    expected = negatives_by_force(rows, lambda i: i % 3 == 0)
    assert expected and mined(spark, rows) == expected
    assert mined(spark, rows, block_anchors=4, shard_rows=7) == expected
    assert mined(spark, rows, positives=2, negatives=3, low=0, high=100) == negatives_by_force(rows, lambda i: i % 3 == 0, 2, 3, 0, 100)


def test_hard_negatives_tiles_and_pruning(spark, monkeypatch):
    for name, value in (("TILE_ROWS", 5), ("TILE_ANCHORS", 2), ("PRUNE_AT", 10)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(1)
    ids, labels, v = r.permutation(200), r.integers(0, 3, 200), np.floor(r.normal(size=(200, 4)) * 40)
    s = v @ v.T
    block = hard_negatives._Block(ids[:7], labels[:7], v[:7], None, 6, 0, 0)
    for at in range(0, 200, 5):
        block.score(ids[at : at + 5], np.zeros(5, bool), labels[at : at + 5], v[at : at + 5])
    got = [x for b in block.rows() for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    for k in range(7):
        want = sorted((-int(s[k, j]), int(ids[j])) for j in range(200) if labels[j] == labels[k])[:6]
        assert [(-x[2], x[3]) for x in got if x[0] == ids[k]] == want


def test_hard_negatives_large_values_and_empty(spark):
    rows = [(0, [1e9, 1.0], 0), (1, [1e9, 2.0], 0), (2, [4e8, 0.5], 1), (3, [1e300, 1.0], 1), (4, [2.0**31, 3.0], 1), (5, [2.0**60], 1)]
    assert mined(spark, rows) == negatives_by_force(rows, lambda i: i % 3 == 0)
    assert mined(spark, []) == [] == mined(spark, [(0, [1.0], 1)]) == mined(spark, [(1, [1.0], 1), (2, [1.0], 0)])
    below = [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.5], 1)]
    assert mined(spark, below) == []
    clash = [(k, [float(k)], k % 2, "x", 1.0) for k in range(8)]
    assert mined(spark, clash, VECTORS + ", score string, anchor_no double") == negatives_by_force([x[:3] for x in clash], lambda i: i % 3 == 0)


def test_hard_negatives_query(spark):
    got, sql = queries.op11_hard_negatives(spark, SF).toPandas(), by_sql("op11_hard_negatives")
    assert len(got) and got[sql.columns].sort_values(list(sql.columns[:3])).values.tolist() == sql.sort_values(list(sql.columns[:3])).values.tolist()


# --- 12 licenses


def scanned(spark, texts, **more):
    docs = spark.createDataFrame([(k, t, "mine", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, Labels string, score double")
    return {r.doc_id: r for r in scan_licenses(docs, **more).collect()}


def test_license_phrases(spark):
    said = "Under the MIT\tLicense, or the (Apache)-License; not mit. license? CC-BY. GNU general\x00PUBLIC License gnu general public licenses"
    got = scanned(spark, [said, None, "", "!!", "mit", "license mit", "mit license mit license", "İmit license", "K mit license"])
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (21, 5, 2, 13, "apache,cc-by,gpl,mit")
    for k in (1, 2, 3, 4, 5):
        assert (got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels, got[k].labels, got[k].score) == (0, None, None, "", "", 0)
    assert (got[6].n_base, got[6].first_word, got[6].last_word, got[6].n_words) == (2, 0, 2, 4)
    assert got[7].n_base == 0 and got[8].n_base == 1 and got[8].first_word == 1 and [got[k].n_words for k in (1, 2, 3, 7)] == [0, 0, 0, 2]


def test_license_notices_changed_cut_and_repeated(spark):
    notice = next(t.text for t in license_scan.NOTICES if t.label == "bsd")
    w = notice.split()
    put_in = " ".join([*w[:8], "plus", "two", *w[8:14], *w[15:]])  # two words in, one out
    texts = [notice, put_in, " ".join(w[:6]), f"{notice} and {notice.upper()}", " ".join(w[k] for k in range(len(w) - 1, -1, -1)), f"{' '.join(w[:10])} {'x ' * 40} {' '.join(w[10:])}"]
    got = scanned(spark, texts)
    assert [got[k].labels for k in range(6)] == ["bsd", "bsd", "", "bsd", "", ""]
    assert got[0].score == 1 and 0.6 <= got[1].score < 1 and got[3].n_spans == 2 and got[0].base_labels == ""
    spans = license_scan.license_spans(license_scan.marked_words(spark.createDataFrame([(1, f"see here: {put_in}")], "doc_id long, text string"))).collect()
    assert [(s["first"], s["last"], s.label) for s in spans] == [(2, 2 + len(w), "bsd")]
    only = scanned(spark, ["alpha beta gamma", "alpha gamma"], templates=(Template("own", "Alpha, beta!", True),))
    assert [only[k].base_labels for k in (0, 1)] == ["own", ""]
    with pytest.raises(ValueError):
        scanned(spark, ["x"], templates=(Template("one", "word"),))


def test_license_rows_repeated_null_and_long(spark):
    rows = [(1, "mit license"), (1, "mit license"), (None, "mit license"), (None, "mit license"), (None, None), (2, "w " * 60_000 + "apache license " * 200)]
    got = sorted((tuple(r) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "labels").collect()), key=repr)
    assert got == sorted([(1, 2, 1, 0, 0, "mit")] * 2 + [(None, 2, 1, 0, 0, "mit")] * 2 + [(None, 0, 0, None, None, ""), (2, 60_400, 200, 60_000, 60_398, "apache")], key=repr)
    empty = scan_licenses(spark.createDataFrame([], "name string, body string"), id_col="name", text_col="body")
    assert empty.count() == 0 and empty.columns[0] == "name"


def test_license_query_and_plan(spark):
    got, sql = queries.op12_license_scan(spark, SF).toPandas(), by_sql("op12_license_scan")
    key = lambda d: sorted(map(repr, d[list(sql.columns)].astype(object).where(d.notna(), None).values.tolist()))
    assert (got.n_base > 0).any() and [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(sql)]
    plan = license_scan.marked_words(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("FileScan") == 1


# --- 13 whitening


def whitened(spark, vectors, ids=None, **more):
    rows = [(k if ids is None else ids[k], v, 1) for k, v in enumerate(vectors)]
    return whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3), **more).toPandas()


def check_whitening(got, vectors, components):
    x = np.floor(64 * np.array(vectors)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == (n, components) and (got.n == n).all()
    assert np.allclose(np.abs(w), np.abs(c @ (u / np.sqrt(e))), atol=1e-7)
    assert np.allclose(np.cov(w.T, bias=True), np.eye(components), atol=1e-9) and got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] < 1e-9
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, e / np.trace(c.T @ c / n), rtol=1e-9)
    assert got.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == ((n * x - s) ** 2).sum(1).tolist()


def test_whitening_like_eigenvectors(spark):
    r = np.random.default_rng(3)
    v = (r.normal(size=(300, 9)) * np.geomspace(1, 100, 9)).tolist()
    check_whitening(whitened(spark, v), v, 9)
    check_whitening(whitened(spark, v, components=4, fan_in=2), v, 4)


def test_whitening_without_spread_and_odd_rows(spark):
    r = np.random.default_rng(4)
    flat = np.concatenate([r.normal(size=(50, 3)), np.ones((50, 1))], axis=1)
    flat = np.concatenate([flat, flat[:, :1]], axis=1).tolist()  # rank 3 of 5
    check_whitening(whitened(spark, flat), flat, 3)
    odd = [*flat, None, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] * 5, [1.0] * 4, []]
    check_whitening(whitened(spark, odd), flat, 3)
    for rows in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None], [[]], [[], []]):
        assert len(whitened(spark, rows)) == 0
    same = whitened(spark, [[0.0, 1.0], [0.0, 1.0], [4.0, 2.0]], ids=[None, None, 7])
    assert len(same) == 3 and same.vec_id.isna().sum() == 2
    huge = whitened(spark, [[1e18, 0.0], [-1e18, 0.0], [1.0, 3.0]])
    assert huge.deviation.isna().any() and huge.identity_error.max() < 1e-6


def test_jacobi_keeps_small_values():
    r = np.random.default_rng(8)
    for d in (1, 2, 7, 20):
        q, _ = np.linalg.qr(r.normal(size=(d, d)))
        sizes = np.geomspace(1, 1e-12, d)
        a = q * sizes  # columns of very different lengths, already orthogonal
        sigma, v = whitening.one_sided_jacobi(a)
        assert np.allclose(sigma, sizes, rtol=1e-12) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
        b = r.normal(size=(d + 3, d))
        sigma, v = whitening.one_sided_jacobi(b)
        assert np.allclose(sigma, np.linalg.svd(b)[1]) and np.allclose(np.linalg.norm(b @ v, axis=0), sigma)


def test_whitening_query(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    check_whitening(queries.op13_whitening(spark, SF).toPandas(), [list(map(float, v)) for v in e.embedding], 32)
