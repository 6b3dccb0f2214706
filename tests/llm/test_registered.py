"""Every registered query of an operator, as the driver calls it, on the smallest tables: against brute force where there is one."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarryspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_all_are_registered():
    assert sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1])) == list(QUERIES) and [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))


def test_op1(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op1_language_id")}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and docs[i].lang is not None and any(map(str.isalpha, docs[i].text or ""))]
    assert sum(got[i].lang_pred == docs[i].lang for i in held) >= 0.95 * len(held) > 0
    assert all((got[i].lang_pred == "und") == (not any(map(str.isalpha, d.text or ""))) for i, d in docs.items())


def test_op2(spark, docs):
    split = {i: WORD.findall(d.text or "") for i, d in docs.items()}
    windows = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op2_substring_dedup")}
    want = {}
    for i, w in split.items():
        gone = {j for k in range(len(w) - 34) if windows[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    assert got == want and any(n for _, n, _ in want.values())


def test_op3(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op3_media")}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        raw = (d.text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])) and r.media_bytes > r.payload_bytes


def test_op4(spark, docs):
    sets = {}
    for i, d in docs.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in d.text or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    ids = sorted(sets)
    part = {i: i for i in ids}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= 85 * max(len(sets[i]), len(sets[j])):
                common = len(sets[i] & sets[j])
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((root(i), root(j)))
                    part[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, "op4_near_dedup")}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_op6(spark, docs):
    plain, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for i in sorted(docs):
        ids = [*plain.encode(docs[i].text or "", add_special_tokens=False).ids, 2]
        want[i] = at, len(ids), crc(ids)
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op6_token_files")} == want


def test_op7(spark):
    got = {r.page_id: r for r in rows(spark, "op7_html_text")}
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert got.keys() == pages.keys() and all(r.n_chars == len(r.text) and r.url == pages[i].url and "<script" not in r.text for i, r in got.items())


def test_op9(spark, docs):
    plain, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, d in docs.items():
        ids = [*plain.encode(d.text or "", add_special_tokens=False).ids, 0]
        want |= {(i, k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))}
    got = rows(spark, "op9_packing")
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 2048
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1


def test_op10(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in rows(spark, "op10_quality")}
    assert got.keys() == docs.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and labels.get(i) is not None]
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.9 * len(held) > 0
