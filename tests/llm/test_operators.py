"""Each operator against a brute-force version, an exact round trip or held-out accuracy; nulls, empties, ties, repeats, clashes."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryspark.llm import html_text, language_id, mixing, near_dedup, packing, quality, substring_dedup, token_files, topk_search, transport_stream, words
from quarryspark.llm.tokens import UnitEncoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: two different words of equal letters at places that polynomials modulo 2**64 can't tell apart
TWINS = ["".join("ab"[bin(k).count("1") % 2 ^ flip] for k in range(1024)) for flip in (0, 1)]
ODD = ["", " ", None, "a", "a a a", "tab\tand  two \n\nspaces", "Ünïcode wörds ÄÖ", "x" * 3000, "\x1c odd \xa0 blanks　"]


def documents(spark, texts, sources=None, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", None if sources is None else sources[k], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# --- words


@given(st.lists(st.text(alphabet="aB \t\né\x1c　z", max_size=30), max_size=8), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_word_hashes_stand_for_words(texts, size):
    h, at = words.all_word_hashes([t.encode() for t in texts])
    split = [WORD.findall(t) for t in texts]
    assert np.diff(at).tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    windows = [tuple(flat[k : k + size]) for k in range(len(flat) - size + 1)]
    assert len(set(words.window_hashes(h, size).tolist())) == len(set(windows))


# --- 1 language


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language_id.remainder("doc_id", 4) == 2
    model = language_id.train_language_id(docs, ~held, sample_rows=400)
    got = language_id.identify_language(docs.withColumn("Score", F.lit("mine")), model).withColumn("held", held).toPandas()
    assert (got.lang_pred == got.lang)[got.held].mean() > 0.97 and got.score.between(0, 1).all() and not got.ambiguous.mean() > 0.02
    odd = {r.doc_id: r for r in language_id.identify_language(documents(spark, [*ODD, "123 !!", "the"]), model).collect()}
    assert [odd[k].lang_pred for k in (0, 1, 2, 9)] == ["und"] * 4 and odd[2].score == 0 and odd[3].lang_pred in model.languages
    assert language_id.identify_language(documents(spark, []), model).count() == 0
    assert language_id.train_language_id(documents(spark, [None, ""]), F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify_language(documents(spark, ["x"]), None).collect()} == {"und"}
    one = language_id.train_language_id(documents(spark, ["some text", "more"]), F.lit(True))
    assert language_id.identify_language(documents(spark, ["any"]), one).first().lang_pred == "en"


def test_language_sample_is_not_cut(spark, monkeypatch):
    """The fit sees about 4000 rows where there are more."""
    seen = []
    monkeypatch.setattr(language_id, "fit_languages", lambda x, langs, dims: seen.append((x.shape, collections.Counter(langs))))
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('some words ', id) as text", "if(id % 3 = 0, 'a', 'b') as lang")
    language_id.train_language_id(docs, F.lit(True), dims=64)
    ((rows, _), langs), = seen
    assert abs(rows - 4000) < 300 and abs(langs["a"] - 2000) < 200 and sum(langs.values()) == rows


@pytest.mark.parametrize("k", [1, 2, 4, 7, 8, 20])
def test_codewords(k):
    c = language_id.codewords(k)
    assert c.shape[0] == k and len({tuple(r) for r in c}) == k
    if k > 2:
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= 2


# --- 2 substrings


def _removed(texts, n):
    w = [WORD.findall(t or "") for t in texts]
    c = collections.Counter(tuple(x[i : i + n]) for x in w for i in range(len(x) - n + 1))
    out = []
    for x in w:
        gone = set()
        for i in range(len(x) - n + 1):
            if c[tuple(x[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(y for i, y in enumerate(x) if i not in gone)
        out.append((len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substrings(spark):
    r = random.Random(2)
    passage = prose(r, 20)
    texts = [*ODD, passage, f"before {passage} after", prose(r, 50, 3), "same same " * 30, prose(r, 200), prose(r, 7)] + [prose(r, 30, 4) for _ in range(15)]
    texts += [texts[-1], texts[10]]
    d = documents(spark, texts, ids=[5 if k < 2 else k for k in range(len(texts))]).withColumn("N_words", F.lit("clash")).withColumn("at", F.monotonically_increasing_id()).repartition(3)
    for unit, batch in ((200, 100), (1000, 200), (1_000_000, 1_000_000)):
        got = substring_dedup.remove_repeated_passages(d, window=6, unit_bytes=unit, batch_bytes=batch, shard_windows=30)
        assert [c.lower() for c in got.columns].count("n_words") == 1
        rows = sorted(got.collect(), key=lambda r: r.at)
        assert sorted((x.n_words, x.n_removed, x.kept_sha256, x.kept_text) for x in rows) == sorted(_removed(texts, 6))
    assert substring_dedup.remove_repeated_passages(documents(spark, [])).count() == 0


@pytest.mark.parametrize("word", [TWINS, [w[:32] for w in TWINS], ["x" * 64 + "a", "x" * 64 + "b"]])
def test_different_words_stay_different(spark, word):
    rest = " ".join(f"w{k}" for k in range(34))
    apart = documents(spark, [f"{w} {rest}" for w in word])
    assert [x.n_removed for x in substring_dedup.remove_repeated_passages(apart, window=35).collect()] == [0, 0]
    # the same as words of a text: windows of 32 words from two letters
    spelt = [" ".join(w[:32]) + f" end{k}" for k, w in enumerate(TWINS)]
    assert [x.n_removed for x in substring_dedup.remove_repeated_passages(documents(spark, spelt), window=32).collect()] == [0, 0]
    near = near_dedup.near_duplicates(documents(spark, word)).collect()
    assert all(x.kept and x.n_shingles == 1 for x in near)
    assert len(set(words.word_hashes([w.encode() for w in word])[0].tolist())) == 2


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=50, deadline=None)
def test_sorted_numbers_round_trip(xs):
    v = np.array(sorted(set(xs)), "uint64")
    assert (substring_dedup.decode_sorted(substring_dedup.encode_sorted(v)) == v).all()


# --- 3 media


def test_media_round_trip(spark):
    texts = [*ODD, "é" * 5000, "a" * 64, "b" * 8192, "c" * 20_000]
    got = {r.doc_id: r for r in transport_stream.media_digests(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = got[k]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert x.media_bytes % 188 == 0 and "discontinuities=0;duplicates=0;bad_sections=0" in x.feature and len(x.pts) == len(x.random_access) == -(-len(want) // 8192)
    two = transport_stream.read_media(transport_stream.store_media(documents(spark, ["abc", "abc"]).withColumn("MEDIA", F.lit(1)))).select("media_sha256", "payload_sha256").distinct()
    assert two.count() == 1
    assert transport_stream.media_digests(documents(spark, [])).count() == 0


def test_damaged_streams():
    t = transport_stream
    media = t.mux(t.padded("x" * 3000))
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    lost = t.demux(b"".join(packets[:5] + packets[6:]))
    assert lost.discontinuities == 1
    again = t.demux(b"".join(packets[:5] + packets[4:]))
    assert again.duplicates == 1 and again.payload() == t.demux(media).payload()
    broken = bytearray(media)
    broken[10] ^= 1
    assert t.demux(bytes(broken)).bad_sections == 1
    filled = t.demux(b"".join(x for p in packets for x in (p, bytes([0x47, 0x1F, 0xFF, 0x10]) + bytes(184))))
    assert filled.payload() == t.demux(media).payload()
    with pytest.raises(ValueError, match="transport"):
        t.demux(b"no stream")
    assert t.demux(b"").packets == 0


# --- 4 near-duplicates


def _components(texts, k, percent, ids):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def _edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark):
    r = random.Random(4)
    base = [prose(r, 60), prose(r, 90), prose(r, 12)]
    texts = [*ODD, "A b", "a B", *base, base[0].upper()] + [_edited(r, base[k % 2], k % 6) for k in range(40)] + [prose(r, 40) for _ in range(10)]
    ids = r.sample(range(1000), len(texts))
    for k, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(documents(spark, texts, ids=ids).repartition(3), shingle=k, percent=percent).collect()
        want = _components(texts, k, percent, ids)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    d = documents(spark, texts, ids=ids)
    assert near_dedup.drop_near_duplicates(d).count() == len({c for _, c in _components(texts, 5, 80, ids).values()})
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    nulls = near_dedup.near_duplicates(documents(spark, ["a b c d", "a b c d", "a b c d"], ids=[None, 3, 3])).collect()
    assert sorted((x.doc_id, x.component_id, x.kept) for x in nulls if x.doc_id) == [(3, 3, True)] * 2 and sum(x.doc_id is None and x.kept for x in nulls) == 1


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    for n, share in ((1, 1.0), (5, 0.4), (300, 0.8), (3000, 0.5)):
        both = r.integers(0, 2**63, round(n * share), dtype="uint64")
        own = r.integers(0, 2**63, (2, n - len(both)), dtype="uint64")
        a, b = (np.concatenate([both, o]) for o in own)
        s = near_dedup.fast_similarity_sketch([a, b, np.empty(0, "uint64")], 512)
        j = len(both) / (len(both) + own.size)
        assert abs((s[0] == s[1]).mean() - j) < 6 * math.sqrt(max(j * (1 - j), 1e-6) / 512) + 1e-9 and not s[2].any()


# --- 5 search


def _bm25(docs, queries, k):
    tok = lambda x: ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", x or "")]
    d = {i: collections.Counter(tok(t)) for i, t in docs}
    length = {i: sum(c.values()) for i, c in d.items()}
    mean, df = sum(length.values()) / len(d), collections.Counter(w for c in d.values() for w in c)
    out = {}
    for q, text in queries:
        s = collections.defaultdict(float)
        for w, n in collections.Counter(tok(text)).items():
            for i, c in d.items():
                if c[w]:
                    s[i] += n * math.log(1 + (len(d) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean))
        out[q] = sorted(((round(x, 9), -i) for i, x in s.items()), reverse=True)[:k]
    return out


@pytest.mark.parametrize("shard", [2000, 10**9])
def test_search(spark, shard):
    r = random.Random(5)
    texts = [*ODD] + [prose(r, r.randrange(1, 80), 60) for _ in range(300)]
    texts += texts[-20:]
    asked = [(0, prose(r, 6, 60)), (1, None), (2, "nothing-known zz"), (3, texts[30]), (4, "w1 W1, w1. w2")]
    q = spark.createDataFrame(asked, "item_id long, text string")
    got = collections.defaultdict(list)
    for x in sorted(topk_search.search_top_k(documents(spark, texts).repartition(3), q, k=7, shard_bytes=shard, query_block=2).collect(), key=lambda x: x["rank"]):
        got[x.query_id].append((round(x.score, 9), -x.doc_id))
    want = {k: v for k, v in _bm25(list(enumerate(texts)), asked, 7).items() if v}
    assert dict(got) == want
    assert topk_search.search_top_k(documents(spark, []), q).count() == 0


@pytest.mark.parametrize("passes", [(64, 8, 1), (4, 1), (1,)])
def test_long_queries(spark, passes):
    """Whole texts as queries, with groups of exact copies, over any passes."""
    r = random.Random(6)
    texts = [*ODD] + [prose(r, r.randrange(1, 300), r.choice([5, 60, 4000])) for _ in range(250)]
    texts += [texts[20]] * 30
    d = documents(spark, texts).repartition(3)
    for shard in (3000, 10**9):
        got = collections.defaultdict(list)
        for x in sorted(topk_search.search_top_k(d, d.filter("doc_id % 7 = 0 or doc_id = 20"), k=6, query_id_col="doc_id", shard_bytes=shard, passes=passes).collect(), key=lambda x: x["rank"]):
            got[x.query_id].append((round(x.score, 9), -x.doc_id))
        asked = [(k, t) for k, t in enumerate(texts) if k % 7 == 0 or k == 20]
        assert dict(got) == {k: v for k, v in _bm25(list(enumerate(texts)), asked, 6).items() if v}


def test_blocks_are_skipped_and_nothing_is_lost():
    """Documents of four vocabularies: bounds rule most out, and what is found is what scoring all finds."""
    r = random.Random(7)
    texts = [" ".join(f"{'abcd'[k % 4]}{min(r.randrange(1, 400), r.randrange(1, 400))}" for _ in range(r.randrange(20, 90))) for k in range(1200)]
    hashes, at = topk_search.terms_of(texts)
    terms = words.distinct_sorted(hashes)
    df = collections.Counter(t for lo, hi in zip(at, at[1:], strict=False) for t in set(hashes[lo:hi].tolist()))
    stats = topk_search.Statistics(len(texts), len(hashes) / len(texts), np.array([math.log1p((len(texts) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()]))
    index = topk_search.ShardIndex(np.arange(len(texts)), texts, stats)
    which = list(range(0, 1200, 40))
    runs = [np.unique(hashes[at[q] : at[q + 1]], return_counts=True) for q in which]
    asked = topk_search.QueryTerms(np.array(which), np.cumsum([0] + [len(t) for t, _ in runs]), np.searchsorted(terms, np.concatenate([t for t, _ in runs])), np.concatenate([c for _, c in runs]), terms)
    q, docs, score = index.answer(asked, stats.idf, np.zeros(len(which)), 10)
    want = _bm25(list(enumerate(texts)), [(k, texts[k]) for k in which], 10)
    got = {k: [(round(s, 9), -d) for s, d in zip(score[q == k].tolist(), docs[q == k].tolist(), strict=True)] for k in which}
    assert got == want
    floor = np.array([want[k][-1][0] for k in which]) - 1e-9
    again = index.answer(asked, stats.idf, floor, 10)
    assert all((x == y).all() for x, y in zip((q, docs, score), again, strict=True))
    assert len(index.answer(asked, stats.idf, floor * 3, 10)[0]) < len(q) / 2
    # few blocks hold more than one vocabulary
    mixed = [len({texts[d][0] for d in index.ids[b : b + 32]}) for b in range(0, 1200, 32)]
    assert sum(m > 1 for m in mixed) < len(mixed) / 2


def test_registered_search_asks_every_twentieth_document(spark):
    from quarryspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    asked = sorted(r for r in rows if r[0] % 20 == 0)[:3]
    found = QUERIES["op5_topk_search"](spark, SF).collect()
    assert {x.query_id for x in found} == {i for i, t in rows if i % 20 == 0 and re.search(r"[A-Za-z0-9\x80-\U0010ffff]", t or "")}
    got = {i: [(round(x.score, 9), -x.doc_id) for x in sorted(found, key=lambda x: x["rank"]) if x.query_id == i] for i, _ in asked}
    assert got == {i: v for i, v in _bm25(rows, asked, 10).items() if v}


# --- 6 tokens


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", None)])
@given(texts=st.lists(st.text(alphabet="ab'sé!.# \n\t\xa0\x1c12ΣA", max_size=40), max_size=6))
@settings(max_examples=80, deadline=None)
def test_units_encode_as_whole_texts(name, blanks, texts):
    e = _encoder(name, blanks)
    assert [x.tolist() for x in e.encode(texts)] == [x.tolist() for x in e.whole(texts)]


_made = {}


def _encoder(name, blanks):
    if (name, blanks) not in _made:
        _made[name, blanks] = UnitEncoder(P.path(name), blanks)
    return _made[name, blanks]


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", None), ("word_bpe_49k.json", None)])
def test_added_tokens_are_one_id(name, blanks):
    plain = Tokenizer.from_file(P.path(name))
    texts = ["<|endoftext|>", "some words <|endoftext|> and more, some words", "joined<|endoftext|>words.<|startoftext|>!", "(<|endoftext|>) <|EndOfText|>", "a <|startoftext|>\n<|endoftext|>\nb", "<|endof text|> <|end", "some words, plain"]
    e = UnitEncoder(P.path(name), blanks)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert plain.token_to_id("<|endoftext|>") in want[1]
    assert [x.tolist() for x in e.encode(texts)] == [x.tolist() for x in e.whole(texts)] == want


def test_token_files(spark, tmp_path):
    texts = [*ODD, "some words " * 500, "a <|endoftext|> b"]
    ids = [7, 3, None, 9, 3, 1, 12, 40, 5, 2, -(2**63)]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    order = sorted(range(len(texts)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k] is not None, (texts[k] or "").encode()))
    start, want = 0, []
    for k in order:
        e = [*t.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        want.append((ids[k], start, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        start += len(e)
    got = token_files.token_file_digests(documents(spark, texts, ids=ids), P.path("byte_bpe_50k.json"), blanks="leading", shard_ids=600, frame_ids=100)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert token_files.token_file_digests(documents(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_seek_table(tmp_path):
    import zstandard

    r = np.random.default_rng(0)
    docs = [(k, r.integers(0, 50_000, n, dtype="uint32").astype("<u4")) for k, n in enumerate([0, 5, 3000, 1, 0, 170, 900, 0])]
    w = token_files.ShardWriter(frame_ids=100)
    for d in docs:
        w.add(*d)
    raw = b"".join(w.parts())
    with pa.BufferReader(raw) as f:
        reader = token_files.ShardReader(f)
        assert len(reader.entries) > 2
        assert [(d, ids.tolist()) for d, _, ids in reader] == [(d, ids.tolist()) for d, ids in docs]
        assert all(reader.document(k).tolist() == ids.tolist() for k, ids in docs if len(ids))
        import xxhash

        assert [int(c) for c in reader.entries[:, 2]] == [xxhash.xxh64_intdigest(reader.frame(k).tobytes()) % 2**32 for k in range(len(reader.entries))]
    everything = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert everything[: 4 * sum(len(i) for _, i in docs)] == b"".join(i.tobytes() for _, i in docs)
    bad = bytearray(raw)
    bad[-20] ^= 1
    with pytest.raises(Exception), pa.BufferReader(bytes(bad)) as f:  # noqa: B017, PT011
        list(token_files.ShardReader(f))


# --- 7 pages


def test_main_text(spark):
    learned = html_text.learn_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    assert learned.signs["<article"] > 1 and learned.signs["<nav"] < -2 and learned.signs["ad"] < -2 and all(v < 0 for v in learned.tags.values())
    page = '<html><head><title>no</title></head><body><div class="cookie-notice">We use <p>cookies</p></div><header><h1>Site</h1></header><nav><a>x</a></nav>{}<h2>Title</h2><p>Hello <a href=x>wor<b>ld</b></a>&nbsp;and\n all &amp; &lt;</p><script>var t="</p>";</script><aside>see also</aside><!-- c --><p>More text here.<p>Open{}<div class="comments"><p>I like it very much</p></div><form>name</form><footer>bye</footer>'
    want = "Title\nHello world and all & <\nMore text here.\nOpen"
    for w in (learned, html_text.PageWeights()):
        assert html_text.main_text(page.format("<article>", "</article>"), w) == want
        assert html_text.main_text(page.format('<div id="content">', "</div>"), w) == want
    for empty in (None, "", "<html></html>", "<nav>a b c</nav>", "<script>x"):
        assert html_text.main_text(empty, learned) == ""
    assert html_text.main_text("plain words only", learned) == "plain words only"
    pages = spark.createDataFrame([(1, "u", None), (2, "u", "<article>a<p>b</article>")], "page_id long, url string, html string").withColumn("TEXT", F.lit(0))
    assert {r.page_id: (r.text, r.n_chars) for r in html_text.extract_main_text(pages, learned).collect()} == {1: ("", 0), 2: ("a\nb", 3)}
    assert html_text.extract_main_text(pages.limit(0), html_text.learn_weights(pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><meta charset=utf-8><style>p {}</style><body><p>All of it.</p></body></html>", "All of it."),
        ("<head><title>T</title><script>a('<body>')</script><link rel=x>\n<article><p>All of it.</p></article>", "All of it."),
        ("<head lang=en><!-- <p>no</p> --><title>T</title>All of it.", "All of it."),
        ("<head><title>T</title></head><body><p>All of it.</p><p>And more.</p>", "All of it.\nAnd more."),
        ("<head><script>a('<body></head>')</script><title>T</title></head><p>All of it.</p>", "All of it."),
        ("<head><title>T</title><body><p>All of it.</p><code>&lt;/head></code>", "All of it.\n</head>"),
        ("<head><title>T</title>", ""),
        ("<body><p>Before <svg class='i' href=\"a>b\" /> after.</p><p>And more.</p>", "Before\nafter.\nAnd more."),
        ("<body><p>One.</p><math/><p>Two.</p><svg><text>no</text></svg><p>Three.</p>", "One.\nTwo.\nThree."),
        ("<body><p>One.</p><svg><path d='x'/><text>no</text></svg><p>Two.</p>", "One.\nTwo."),
    ],
)
def test_open_heads_and_empty_foreign_elements(page, text):
    assert html_text.main_text(page, html_text.PageWeights()) == text


def test_pages_hold_their_articles(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_main_text(pages, html_text.learn_weights(pages)).collect()}
    for r in pages.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*)</article>", r.html)[1])
        want = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in parts]
        assert got[r.page_id] == "\n".join(x for x in want if x)


_SAID = ["It rained all day long.", "Then the sun came out again, and people went for walks.", "Nobody had thought of it."]
_PROSE = "".join(f"<p>{x}</p>" for x in _SAID)
_LINKS = "".join(f"<li><a href=/{k}>Part {k}</a></li>" for k in range(9))


@pytest.mark.parametrize(
    "page",
    [
        f"<div id=top><ul class=menu>{_LINKS}</ul></div><div id=content>{_PROSE}</div><div id=sidebar><h3>Latest</h3><p>Something else entirely, at some length, to read.</p></div><div id=footer>All rights reserved by us.</div>",
        f"<table class=layout><tr><td><table class=nav><tr><td><a href=a>Home</a><td><a href=b>News</a></table><td><div class=story>{_PROSE}</div><td><div class='ad-slot'>Buy these shoes now, they are very cheap today.</div></table>",
        f"<header><p>The Daily Page</p></header><div role=main><section>{_PROSE}</section></div><section class='comments-section'><p>First! I like this a lot, thank you very much.</p></section><form><p>Your name</p></form>",
        f"<div class=cookie-banner><p>We use cookies to make this site better for you.</p></div><div class='blog-post'>{_PROSE}<div class=share-buttons><a href=x>Share this</a></div></div><div class='comment-list'><p>I do not agree with any of this at all.</p></div>",
        f"<nav><ul>{_LINKS}</ul></nav>{_PROSE}<footer><p>Written by somebody who lives somewhere far away.</p></footer>",
        f"<div class=wrapper><div class=site-header><h1>Site</h1></div><div class=row><div class='col main-col'>{_PROSE}</div><aside><p>Read our other stories, of which there are many.</p></aside></div></div>",
    ],
)
def test_templates_without_an_article(spark, page):
    assert html_text.main_text(page, html_text.PageWeights()) == "\n".join(_SAID)
    learned = html_text.learn_weights(spark.read.parquet(f"{SF}/pages.parquet"))
    assert html_text.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>", learned) == "\n".join(_SAID)


def test_class_words_are_priors_only():
    page = '<article><div class="text-header">Lead paragraph of it.</div><div class="search-results-explained">How results are found.</div><div class="ad">Buy this.</div><p>The end.</p></article>'
    assert html_text.main_text(page, html_text.PageWeights()) == "Lead paragraph of it.\nHow results are found.\nThe end."
    # pages whose articles live in what a word calls a widget outweigh the word
    counts = collections.Counter()
    for k in range(30):
        html_text.count_page(f"<body><nav>Home</nav><div class=widget><article><p>Text {k} of it.</p></article></div><div class=story>Buy this.</div></body>", counts)
        html_text.count_page(f"<body><div class=story>Buy that.</div><article><div class=widget>Some {k} words.</div></article></body>", counts)
    learned = html_text.weights_of(counts)
    assert learned.sign("widget") > html_text.prior("widget") and learned.sign("widget") > 0 > -1 > learned.sign("story")
    assert html_text.main_text("<div class=widget><p>Text of a page, and more.</p></div><div class=story>Buy this now.</div>", learned) == "Text of a page, and more."


@pytest.mark.parametrize("unit", ["<nav>", "</nav>", "<div><nav></div>", "<div class=a>x", "</article>", "<p>word </p>", "<b", "<a '", "<!--", "&amp;"])
def test_long_pages_take_linear_time(unit):
    import time

    weights = html_text.PageWeights()
    took = []
    for size in (100_000, 1_000_000):
        page = unit * (size // len(unit))
        began = time.perf_counter()
        html_text.main_text(page, weights)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 0.5


# --- 8 mixing


def _targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values())
    target, open_ = {}, set(names)
    while True:
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else target
        for s in over:
            target[s] = cap * sizes[s]
            open_.remove(s)


def test_mixing(spark):
    r = random.Random(8)
    texts = [prose(r, r.randrange(0, 40)) for _ in range(300)] + [None, "", "one"]
    sources = [r.choice(["a", "b", "B", "é", None] + ["hot"] * 8) for _ in texts[:-1]] + ["alone"]
    docs = documents(spark, texts, sources)
    got = mixing.mix_sources(docs.repartition(4), bucket_rows=20).collect()
    size = collections.Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(WORD.findall(t or ""))
    want = _targets(dict(size))
    taken = collections.Counter()
    for x in got:
        assert x.size == len(WORD.findall(texts[x.doc_id] or "")) and x.source_size == size[x.source] and abs(x.target - want[x.source]) < 1e-6
        assert 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert all(taken[s] == round(want[s]) for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs, bucket_rows=7).collect()))
    out = collections.Counter()
    for x in mixing.apply_mix(docs, bucket_rows=20).collect():
        out[x.doc_id] += len(WORD.findall(x.text))
    assert out == +collections.Counter({x.doc_id: x.taken for x in got})
    assert mixing.mix_sources(documents(spark, [])).count() == 0 and mixing.mix_sources(documents(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0
    twice = mixing.apply_mix(documents(spark, ["a b c"] * 4, ["s"] * 4, ids=[1, 1, 1, None]))
    assert sum(len(x.text.split()) for x in twice.collect()) == 12


# --- 9 packing


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit_and_bound(sizes):
    s = np.array(sizes, "int64")
    bins, offset, free = packing.best_fit_decreasing(s, 40)
    bound = packing.bound_of_counts(np.bincount(s, minlength=41), 40)
    assert -(-sum(sizes) // 40) <= bound <= len(free) <= max(1, math.ceil(11 / 9 * bound + 6 / 9) + 1) or not sizes
    for b in range(len(free)):
        spans = sorted((int(o), int(o + n)) for o, n in zip(offset[bins == b], s[bins == b], strict=True))
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] == 40 - free[b]


def test_packing(spark):
    r = random.Random(9)
    texts = [*ODD, "a <|startoftext|> b <|EndOfText|>"] + [prose(r, r.randrange(1, 60)) for _ in range(300)]
    d = documents(spark, [*texts, texts[20]], ids=[*range(len(texts)), 20])
    rows = packing.pack_documents(d, P.path("word_bpe_49k.json"), blanks="dropped", capacity=64, part_rows=100).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    for x in rows:
        pieces[x.doc_id].append(x)
    for k, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(n, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for n, a in enumerate(range(0, len(ids), 64))]
        assert sorted({(x.piece, x.start, x.length, x.ids_crc32) for x in pieces[k]}) == want
    bins = collections.defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append((x.offset, x.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= rows[0].overall_bound * 1.02 and len(bins) >= rows[0].overall_bound
    assert packing.pack_documents(documents(spark, []), P.path("word_bpe_49k.json")).count() == 0


# --- 10 quality


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = language_id.remainder("doc_id", 3) == 1
    got = quality.classify_quality(docs, labels, ~held).withColumn("held", held).join(labels, "doc_id").filter("held").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    model = quality.train_quality(quality.with_statistics(docs), labels)
    odd = quality.score_quality(quality.with_statistics(documents(spark, [*ODD, None])), model).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in odd)
    none = quality.classify_quality(documents(spark, ["a", None]), labels.limit(0), F.lit(True)).collect()
    assert [x.score for x in none] == [0.5, 0.5]
    one = quality.classify_quality(documents(spark, ["a", "b"]), spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int"), F.lit(True)).collect()
    assert [x.score for x in one] == [1.0, 1.0]
    assert quality.classify_quality(documents(spark, []), labels, F.lit(True)).count() == 0


def test_gaussian_density():
    r = np.random.default_rng(0)
    x = {k: r.normal(size=(400, quality.N_STATISTICS)) * (1 + k) + 3 * k for k in (0, 1)}
    m = quality.fit_quality({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, 0.0, 0.0)
    z = (x[1][:5] - m.centre) / m.scale
    own = (x[1] - m.centre) / m.scale
    c = np.cov(own.T, bias=True)
    want = np.log(0.5) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z - own.mean(0), np.linalg.inv(c), z - own.mean(0))
    assert np.allclose(m.classes[1].density(z), want)


# --- ids that tell nothing apart, words that no blank parts


def test_samples_do_not_hang_on_ids(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["der und die", "the of and", "les des une"][k % 3].split()) for _ in range(30)) for k in range(600)]
    rows = [(None if k % 2 else 7, t, ["de", "en", "fr"][k % 3], "s", len(t)) for k, t in enumerate(texts)]
    for same in (rows, [(None, *x[1:]) for x in rows], [(7, *x[1:]) for x in rows], rows + [rows[0]] * 900):
        model = language_id.train_language_id(spark.createDataFrame(same, DOCS), F.lit(True), sample_rows=60)
        assert model is not None and sorted(model.languages) == ["de", "en", "fr"]
        got = language_id.identify_language(spark.createDataFrame(same[:90], DOCS), model).collect()
        assert sum(x.lang_pred == x.lang for x in got) >= 88
    pages = [(None, f"<body><nav>menu {k}</nav><article><p>some text number {k} of the page</p></article></body>") for k in range(300)]
    weights = html_text.learn_weights(spark.createDataFrame(pages, "page_id long, html string"), sample_rows=30)
    assert weights != html_text.learn_weights(spark.createDataFrame([], "page_id long, html string"), sample_rows=30)


def test_windows_are_counted_by_words(spark, tmp_path):
    from quarryspark.runtime import shared_folder

    r = random.Random(4)
    words_ = [[f"w{r.randrange(900)}" for _ in range(r.randrange(0, 300))] for _ in range(40)]
    right = sum(max(0, len(w) - 34) for w in words_)
    for gap in (" ", "\t", "\r", "\n\n ", "\x0b\x0c"):
        d = documents(spark, [gap + gap.join(w) + gap for w in words_])
        units = substring_dedup.write_units(d.select("doc_id", "text"), shared_folder(spark, "test"), "text", 35, 4_000_000, 4_000_000)
        assert sum(u.windows for u in units.collect()) == right
    assert [substring_dedup.count_words(t) for t in (b"", b" ", b"a", b"\ta  b\n", "ü\u2028x".encode())] == [0, 0, 1, 2, 1]
