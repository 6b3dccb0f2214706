"""Golden vectors of the column expressions."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from quarryspark.functions import content as C
from quarryspark.functions import failures as X
from quarryspark.functions import text as T
from quarryspark.functions import urls as U
from quarryspark.sources import pages


def test_fnv(values):
    assert values(T.fnv1a32, ["", "a", "foobar"]) == [2166136261, 3826002220, 3214735720]

    def by_units(s):
        h, raw = 2166136261, s.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["😀é", "漢字", "a😀b", "x" * 500]
    assert values(T.fnv1a32, texts) == [by_units(t) for t in texts]


def test_paragraphs(values):
    got = values(T.segment_paragraphs, ["First sentence is long enough.<br>\n\nSecond sentence long enough too.", "a long paragraph here</p>\nand another long one", "lone tag stays in</p> one paragraph", "short", "", None, "line one is long enough\n \nline two is long enough"])
    assert [len(g) for g in got] == [2, 2, 1, 0, 0, 0, 1]
    assert values(lambda c: T.segment_paragraphs(c, 0), ["x" * 19]) == [[]]
    assert values(T.fingerprint_set, ["The same paragraph here\n\nthe  SAME paragraph here"])[0].__len__() == 1


def test_tokens(values):
    assert values(T.estimate_tokens, ["a" * 1000, "漢" * 1000, "  ", None, "ab漢"]) == [250, 667, 0, 0, 2]


@pytest.mark.parametrize(("text", "want"), [("hello world foo", "hello…[truncated]"), ("abcdefghijklmnop", "abcdefghij…[truncated]"), (" bcdefghijklmnop", "…[truncated]"), ("short", "short"), ("hello worl d", "hello worl…[truncated]")])
def test_truncation(values, text, want):
    assert values(lambda c: T.truncate_at_word(c, 10), [text]) == [want]
    assert values(lambda c: T.truncate_at_word(c, 0), [text]) == [text]


def test_fields_and_sentences(values):
    assert values(lambda c: T.truncate_field(c, 6), ["abcdef", "abcdefg"]) == ["abcdef", "abc..."]
    assert values(T.first_sentence, ["Hi there. More", "v1.2 is out.", " x ", "A.\nB", ""]) == ["Hi there.", "v1.2 is out.", "x", "A.", ""]
    assert values(T.key_point_sentence, ["v1.2 " + "y" * 300, "Hello. x"]) == ["v1.2 " + "y" * 195, "Hello."]
    assert values(T.clean_title, ["- 1. **Bold**", "* x: ", "2) y —"]) == ["Bold", "x", "y"]


def test_normalize_url(values):
    cases = {
        "https://example.com?ref=homepage": "https://example.com/", "http://example.com:8080/path": "https://example.com:8080/path", "http://example.com?utm_source=x&q=test": "https://example.com/?q=test", "http://h:80/a/": "https://h/a", "http://h:443/": "https://h/", "https://h:80": "https://h:80/",
        "HTTPS://U:p@Ex.COM:443/A/?b=1&a=x%20y&a=2&empty=#z": "https://U:p@ex.com/A?a=x+y&a=2&b=1&empty=", "https://e.com/?utm_custom=1": "https://e.com/?utm_custom=1", "nope": None, "http://": None, "mailto:a@b#x": "mailto:a@b", "https://e.com/a//": "https://e.com/a/", "https://e.com:99999/": None,
    }
    assert values(U.normalize_url, list(cases)) == list(cases.values())
    assert values(lambda c: U.normalize_url(c, ("Foo",)), ["https://e.com/?foo=1&b=2"]) == ["https://e.com/?b=2"]


def test_url_helpers(values):
    assert values(U.clean_url, ["https://a.com/x).", "https://a.com/x)", "https://a.com/(x)", "http://b.c,!"]) == ["https://a.com/x)", "https://a.com/x", "https://a.com/(x)", "http://b.c"]
    assert values(U.extract_urls, ["a https://x.y/z<b http://q"]) == [["https://x.y/z", "http://q"]]
    assert values(U.valid_hit_url, ["https://a.b", "mailto:x@y", "zzz", None]) == ["https://a.b", None, None, None]
    assert values(lambda c: U.search_url(c, F.lit("a b&c"), "news"), ["https://s.org/x//"]) == ["https://s.org/x/search?q=a+b%26c&format=json&safesearch=1&categories=news"]


def test_private_addresses(values):
    assert values(U.is_private_ipv4, ["10.0.0.1", "172.15.0.1", "172.31.0.1", "192.168.1.1", "169.254.0.1", "0.1.2.3", "127.1.1.1", "8.8.8.8", "x", "1.2.3", "300.1.1.1", None]) == [True, False, True, True, True, True, True, False, False, False, False, False]
    assert values(U.is_private_ipv6, ["::1", "::", "fe80::1", "fd00::2", "2001:db8::1", "::ffff:10.0.0.1", "::ffff:0a00:0001", "::8.8.8.8", "1:2:3:4:5:6:7:8", "zz::", "1::2::3"]) == [True, True, True, True, False, True, True, False, False, False, False]
    got = values(U.fetch_error, ["", None, "ftp://x.com", "http://127.0.0.1/a", "http://[::1]/", "https://ok.com", "bad"])
    assert got == [U.URL_REQUIRED, U.URL_REQUIRED, U.ONLY_HTTP, U.PRIVATE_ADDRESS, U.PRIVATE_ADDRESS, None, "Invalid URL: bad"]
    assert values(lambda c: U.fetch_error(c, F.array(F.lit("10.1.1.1"))), ["https://ok.com"]) == [U.PRIVATE_ADDRESS]


def test_failures(values):
    assert values(X.error_category, ["HTTP 404: x", "Request timeout", "ECONNREFUSED", "failed to parse", "Invalid URL: x", "Invalid URL: http://timeout", "Failed to resolve hostname: x", "boo"]) == ["http_error", "timeout", "network", "parse_error", "validation", "timeout", "unknown", "unknown"]
    assert values(X.retry_after_ms, ["5", "100", "x", "", None]) == [5000, 10000, None, None, None]
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    assert values(lambda c: X.retry_after_ms(c, now), ["Mon, 01 Jan 2024 00:00:07 GMT", "Sun, 31 Dec 2023 00:00:00 GMT"]) == [7000, 0]
    assert values(lambda c: X.backoff_ms(c, 500, F.lit(99_999).cast("long")), [1], "int") == [10_000]
    assert values(X.tool_error, ["it was aborted", "boom"]) == [X.TIMED_OUT, "Internal error: boom. See server logs for details."]
    assert len(values(X.tool_success, ["x" * 25_001])[0]) == 25_000 + len(X.RESPONSE_SUFFIX)


def test_content(spark, values):
    assert values(C.format_json, ['{"a":[1,2.0,{}],"b":[]}', "nope", None, "NaN"]) == ['{\n  "a": [\n    1,\n    2,\n    {}\n  ],\n  "b": []\n}', None, None, None]
    assert values(C.strip_xml, ["<a xmlns='x'>hi<b> you</b><![CDATA[<raw>]]></a>", "<a>&amp;<b>"]) == ["hi you<raw>", "&"]
    rows = spark.createDataFrame([("text/html; charset=x", "b"), ("image/png", ""), ("application/ld+json", '{"a":1}'), (None, "<?xml ?><a>z</a>"), ("application/json", "{bad"), ("", " plain")], "ct string, b string")
    assert [tuple(r.r) for r in rows.select(C.route_content("ct", "b").alias("r")).collect()] == [
        ("html", None, None, None), ("binary", None, None, "Unsupported content type: image/png"), ("json", '{\n  "a": 1\n}', "json", None), ("xml", "z", "xml", None), ("json", "{bad", "json", None), ("text", " plain", "raw-text", None),
    ]
    body = spark.createDataFrame([(bytearray("<meta charset='GBK'>中".encode("gbk")), None), (bytearray("é".encode("latin1")), "text/html; charset=ISO-8859-1"), (bytearray(b"\xff"), "x; charset=unheard-of")], "b binary, ct string")
    assert [r[0] for r in body.select(C.decode_bytes("b", C.detect_charset("ct", "b"))).collect()] == ["<meta charset='GBK'>中", "é", "�"]
    assert C.inflate(__import__("gzip").compress(b"x"), "gzip") == b"x" and C.inflate(b"junk", "gzip") == b"junk"
    title, text = C.readable("<html><title>T</title><nav>no</nav><article><h1>H</h1><p>one<p>two<script>x</script></article><footer>f</footer>")
    assert (title, text) == ("T", "H\none\ntwo")
    assert C.readable("") == ("", "") and C.readable(None) == ("", "")


# --- hosts


SPELT_LOOPBACK = [
    "2130706433", "0x7f.1", "127.1", "0177.0.0.1", "127.0.0.1.", "localhost", "LOCALHOST.", "a.localhost", "%31%32%37.0.0.1", "①②⑦.0.0.1", "127。0。0。1", "0x7F000001", "017700000001", "127.0.0x0.01",
    "[::1]", "[0:0:0:0:0:0:0:1]", "[::ffff:127.0.0.1]", "[0:0:0:0:0:ffff:7f00:1]", "[::127.0.0.1]",
]


def test_every_spelling_of_this_machine_is_refused(values):
    got = values(U.fetch_error, [f"http://{h}/" for h in SPELT_LOOPBACK] + ["http://user@127.1:80/x?y", " http://127.1 "])
    assert set(got) == {U.PRIVATE_ADDRESS}
    addresses = values(U.normalize_url, [f"http://{h}/" for h in SPELT_LOOPBACK])
    assert {a for h, a in zip(SPELT_LOOPBACK, addresses, strict=True) if "local" not in h.lower() and "[" not in h} == {"https://127.0.0.1/"}
    assert all(pages.private_address(pages.plain_host(h.strip("[]"))) for h in SPELT_LOOPBACK)


def test_hosts_that_end_in_a_number_are_addresses_or_nothing(values):
    bad = ["http://1.2.3.256/", "http://1.2.3.4.5/", "http://4294967296/", "http://08.1.1.1/", "http://a.1/", "http://1.16777216/", "http://256.1.1.1/"]
    assert values(U.normalize_url, bad) == [None] * len(bad) == values(U.valid_hit_url, bad)
    assert all(e.startswith("Invalid URL: ") for e in values(U.fetch_error, bad))
    good = {"http://1.a/": "https://1.a/", "http://0x1g/": "https://0x1g/", "http://0xffffffff/": "https://255.255.255.255/", "http://1.65793/": "https://1.1.1.1/", "http://0x/": "https://0.0.0.0/", "http://8.8.8.8:80/a/": "https://8.8.8.8/a"}
    assert values(U.normalize_url, list(good)) == list(good.values())
    for b in bad:
        with pytest.raises(ValueError):
            pages.plain_host(b[7:-1])


def test_ipv6_hosts_are_shortened(values):
    good = {"[2001:DB8:0:0:1:0:0:1]": "[2001:db8::1:0:0:1]", "[1:0:0:2:0:0:0:3]": "[1:0:0:2::3]", "[::]": "[::]", "[1::]": "[1::]", "[1:2:3:4:5:6:7::]": "[1:2:3:4:5:6:7:0]", "[::ffff:8.8.8.8]": "[::ffff:808:808]", "[01:2:3:4:5:6:7:08]": "[1:2:3:4:5:6:7:8]"}
    assert values(U.canonical_host, list(good)) == list(good.values())
    assert values(U.canonical_host, ["[1::2::3]", "[1:2]", "[12345::]", "[::1.2.3.256]", "[1:2:3:4:5:6:7:8:9]", "a%00b", "ex%2Fa.com", ""]) == [None] * 7 + [""]


def test_numbers_spelt_at_random_are_the_same_address(values):
    r, hosts, right = random.Random(3), [], []
    for _ in range(120):
        n = r.choice([r.randrange(2**32), r.randrange(256) << 24 | r.randrange(3)])
        k = r.randrange(1, 5)
        parts = [(n >> (24 - 8 * i)) & 255 for i in range(k - 1)] + [n & (256 ** (5 - k) - 1)]
        spell = lambda x: r.choice([str(x), hex(x), hex(x).upper().replace("0X", "0X0"), f"0{x:o}", f"000{x:o}"])
        hosts.append(".".join(map(spell, parts)) + r.choice(["", "."]))
        right.append(str(ipaddress.ip_address(n)))
    assert values(U.canonical_host, hosts) == right == [pages.plain_host(h) for h in hosts]


def test_urls_leave_out_tabs_and_line_breaks(values):
    assert values(U.normalize_url, ["ht\ttp://exa\nmple.com/a\r\nb?x=1", "http://a.com/\n#f", "http://u:p@a.com:0080/../x/./y/?b=2&a=1&utm_source=z", None, "", "x"]) == ["https://example.com/ab?x=1", "https://a.com/", "https://u:p@a.com:80/x/y?a=1&b=2", None, None, None]
