"""URL functions as column expressions.

``normalize_url`` covers absolute URLs with an authority, with hosts in their canonical form
and dot segments of paths resolved; other schemes pass with their fragment dropped. Anything
that is no URL gives null.

A host is canonical as browsers have it: percent signs decoded, names beyond ASCII in their
ASCII form, numbers as four octets however they are spelt (one to four parts, each decimal,
octal after 0 or hexadecimal after 0x, a dot at the end), IPv6 groups without leading zeros
and with the longest run of zeros left out. The check before a fetch looks at that form, so
no spelling of a private address passes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryspark.functions.text import WS, _col, js_trim

#: fixed value: parameters that only track
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "_hsenc", "_hsmi", "igshid", "si")
#: fixed values: messages of the fetch check
PRIVATE_ADDRESS = "URL resolves to a private or loopback address; blocked for security"
URL_REQUIRED, ONLY_HTTP = "URL is required", "Only HTTP(S) URLs are supported"

_SCHEME = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*):"
_SPECIAL = r"(?si)\A(https?|ftp|wss?)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|(?:[^\s/?#:@\[\]<>\\^`{|}%]|%[0-9A-Fa-f]{2})+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


class _Parts:
    """The parts of a URL, taken from one match: those of a web URL, or the text itself of any other."""

    def __init__(self, p: Column):
        self.is_web, self.text = F.size(p) == 6, F.get(p, F.lit(0))
        scheme, self.user, self.host, self.port, self.path, self.query = (F.get(p, F.lit(k)) for k in range(6))
        self.scheme = F.lower(scheme)
        port = F.coalesce(F.try_to_number(F.nullif(self.port, F.lit("")), F.lit("9999999")), F.lit(0))
        other = self.text.rlike(_SCHEME) & ~self.text.rlike(r"(?i)\A(?:https?|ftp|wss?):")
        self.is_shaped = F.when(self.is_web, port <= 65535).otherwise(other)
        self.own_host = F.when(self.is_web, canonical_host(self.host)).otherwise(F.lit(""))


def _parted(c: Column | str, use) -> Column:
    """``use(parts)`` of a text without the blanks around it, nor tabs and line breaks within, which URLs leave out."""
    t = F.translate(js_trim(c), "\t\n\r", "")
    return _let(F.split(F.regexp_replace(t, _SPECIAL, "$1\n$2\n$3\n$4\n$5\n$6"), "\n"), lambda p: use(_Parts(p)))


def _ascii_host(host: Column) -> Column:
    """A name decoded and in lower case, in its ASCII form where there is one."""
    plain = F.when(host.contains("%"), F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)).otherwise(host)
    return F.when(plain.rlike(r"[^\x00-\x7F]"), F.coalesce(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), plain)), F.lower(plain))).otherwise(F.lower(plain))


def _number(part: Column) -> Column:
    """A part of a number host: decimal, octal after 0, hexadecimal after 0x; null for anything else, 2**32 for what is larger."""
    base = F.when(part.startswith("0x"), 16).when(part.rlike(r"\A0."), 8).otherwise(10)
    digits = F.regexp_replace(F.regexp_replace(part, r"\A0x", ""), r"\A0+(?=.)", "")
    fits = F.when(base == 16, part.rlike(r"\A0x[0-9a-f]*\z")).when(base == 8, part.rlike(r"\A[0-7]+\z")).otherwise(part.rlike(r"\A[0-9]+\z"))
    some = F.when(digits == "", F.lit("0")).otherwise(digits)  # 0x alone is nought
    of = lambda b: F.conv(some, b, 10).cast("long")
    value = F.when(F.length(some) > 11, F.lit(2**32)).when(base == 16, of(16)).when(base == 8, of(8)).otherwise(some.try_cast("long"))
    return F.when(fits, value)


#: a host that ends in a number is an address or nothing
_NUMERIC = r"(?:\A|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z"


def _four_octets(host: Column) -> Column:
    """Dotted decimal of a host in lower case that ends in a number; '' where it is no address."""

    def of(parts: Column) -> Column:
        n = F.size(parts)
        last, before = F.element_at(parts, -1), F.slice(parts, F.lit(1), n - 1)
        powers = F.array(*[F.lit(256**k).cast("long") for k in range(5)])
        room = F.get(powers, 5 - n)
        good = (n <= 4) & F.forall(parts, lambda x: x.isNotNull()) & F.forall(before, lambda x: x <= 255) & (last < room)
        value = F.aggregate(F.transform(before, lambda x, at: x * F.get(powers, 3 - at)), last, lambda x, y: x + y)
        octets = _let(value, lambda v: F.concat_ws(".", *[F.shiftright(v, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)]))
        return F.when(F.coalesce(good, F.lit(False)), octets).otherwise(F.lit(""))

    return _let(F.transform(F.split(F.regexp_replace(host, r"\.\z", ""), r"\."), _number), of)


def ipv6_words(c: Column | str) -> Column:
    """The eight 16-bit numbers of an IPv6 address, its last two maybe in dotted decimal; null for what is none."""
    t = F.lower(_col(c))
    dotted = F.regexp_extract(t, r"(?:\A|:)([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\z", 1)
    octet = lambda k: F.element_at(F.split(dotted, r"\."), k).cast("int")
    pair = lambda k: F.lower(F.hex(octet(k) * 256 + octet(k + 1)))
    small = F.forall(F.split(dotted, r"\."), lambda x: x.cast("int") <= 255)
    plain = F.when(dotted == "", t).when(small, F.concat(F.left(t, F.length(t) - F.length(dotted)), pair(1), F.lit(":"), pair(3)))

    def of(halves: Column) -> Column:
        groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
        before, after = groups(F.element_at(halves, 1)), groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
        missing = 8 - F.size(before) - F.size(after)
        filled = F.when((F.size(halves) == 2) & (missing >= 1), F.concat(before, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), after)).when((F.size(halves) == 1) & (missing == 0), before)
        return F.when(F.forall(filled, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z")), F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int")))

    return F.when(plain.isNotNull(), _let(F.split(F.coalesce(plain, F.lit("")), "::"), of))


def _short_ipv6(words: Column) -> Column:
    """Eight numbers with the longest run of zeros, the first of equals, left out."""

    def of(text: Column) -> Column:
        out = text
        for n in range(2, 9):
            run = rf"\A(?:(.*?):)??0(?::0){{{n - 1}}}(?::(.*))?\z"
            out = F.when(text.rlike(run), F.concat(F.regexp_extract(text, run, 1), F.lit("::"), F.regexp_extract(text, run, 2))).otherwise(out)
        return out

    return _let(F.array_join(F.transform(words, lambda w: F.lower(F.hex(w))), ":"), of)


#: names in plain letters, by far the most hosts, need no more than lower case
_ODD_HOST = r"(?i)\A\[|[^A-Za-z0-9.\-_]|" + _NUMERIC


def canonical_host(c: Column | str) -> Column:
    """A URL's host in the form that browsers connect to; null for what is none. IPv6 hosts stand in brackets."""
    raw = _col(c)

    def name(host: Column) -> Column:
        good = F.when(~host.rlike(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]") & (host != ""), host)
        return F.when(host.rlike(_NUMERIC), F.nullif(_four_octets(host), F.lit(""))).otherwise(good)

    def odd(host: Column) -> Column:
        six = F.concat(F.lit("["), _let(ipv6_words(F.substring(host, F.lit(2), F.length(host) - 2)), _short_ipv6), F.lit("]"))
        return F.when(host.startswith("["), six).otherwise(_let(_ascii_host(host), name))

    return F.when(raw.rlike(_ODD_HOST), _let(raw, odd)).otherwise(F.lower(raw))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved."""
    step = lambda done, s: F.when(F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(F.lower(s).isin(".", "%2e"), done).otherwise(F.concat(done, F.array(s)))
    segments = F.split(F.substr(path, F.lit(2)), "/")
    open_end = F.lower(F.element_at(segments, -1)).isin(".", "..", "%2e", ".%2e", "%2e.", "%2e%2e")
    joined = F.concat(F.lit("/"), F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/"), F.when(open_end, F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(?i)/(?:\.|%2e)"), F.regexp_replace(joined, r"\A//\z", "/")).otherwise(path)


def is_url(c: Column | str) -> Column:
    """Whether a URL parser accepts the text: an authority for web schemes, anything after other schemes."""
    return F.coalesce(_parted(c, lambda p: p.is_shaped & p.own_host.isNotNull()), F.lit(False))


def valid_hit_url(c: Column | str) -> Column:
    """The text itself if it is a URL with a host, else null."""
    return F.when(_parted(c, lambda p: p.is_shaped & p.own_host.isNotNull() & (p.is_web | p.text.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"))), _col(c))


def _pairs(query: Column, dropped: Column) -> Column:
    """A query's parameters sorted by name and encoded anew, without those of ``dropped``."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    pair = lambda x, at: F.struct(decode(F.substring_index(x, "=", 1)).alias("k"), at.alias("at"), F.when(F.instr(x, "=") > 0, decode(F.substring(x, F.instr(x, "=") + 1, F.length(x)))).otherwise(F.lit("")).alias("v"))
    kept = F.array_sort(F.filter(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair), lambda p: ~F.array_contains(dropped, F.lower(p["k"]))))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def normalize_url(c: Column | str, extra: tuple[str, ...] = ()) -> Column:
    """https, canonical host, no default port, fragment, tracking parameters or one trailing slash; parameters sorted by name."""
    dropped = F.array(*[F.lit(p.lower()) for p in dict.fromkeys((*TRACKING_PARAMETERS, *extra))])

    def of(p: _Parts) -> Column:
        secure = F.when(p.scheme == "http", F.lit("https")).otherwise(p.scheme)
        usual = (p.scheme.isin("http", "ws") & (p.port == "80")) | (secure.isin("https", "wss") & (p.port == "443")) | ((p.scheme == "ftp") & (p.port == "21"))
        shown_port = F.when(usual | (p.port == ""), F.lit("")).otherwise(F.concat(F.lit(":"), F.regexp_replace(p.port, r"\A0+(?=.)", "")))
        shown_user = F.when(p.user == "", F.lit("")).otherwise(F.concat(p.user, F.lit("@")))
        shown_path = _let(_without_dots(p.path), lambda path: F.when(path == "", F.lit("/")).when((F.length(path) > 1) & path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path))
        shown_query = F.when(p.query == "", F.lit("")).otherwise(_let(_pairs(p.query, dropped), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))))
        web = F.concat(secure, F.lit("://"), shown_user, p.own_host, shown_port, shown_path, shown_query)
        return F.when(p.is_shaped, F.when(p.is_web, web).otherwise(F.substring_index(p.text, "#", 1)))

    return _parted(c, of)


def strip_fragment(c: Column | str) -> Column:
    return F.substring_index(_col(c), "#", 1)


def clean_url(c: Column | str) -> Column:
    """Without one closing bracket that nothing opens, then without trailing punctuation."""
    u = _col(c)
    u = F.when(u.endswith(")") & ~u.contains("("), F.left(u, F.length(u) - 1)).otherwise(u)
    return F.regexp_replace(u, r"[.,;:!]+\z", "")


def extract_urls(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"(https?://[^{WS}<>\"']+)"), F.lit(1))


def search_url(base: Column | str, query: Column | str, categories: str | None = None) -> Column:
    """Address of a metasearch request in JSON with moderate safe search."""
    tail = F.lit("&format=json&safesearch=1") if categories is None else F.concat(F.lit("&format=json&safesearch=1&categories="), F.url_encode(F.lit(categories)))
    return F.concat(F.regexp_replace(F.regexp_replace(_col(base), r"[?#].*\z", ""), r"/+\z", ""), F.lit("/search?q="), F.url_encode(_col(query)), tail)


def is_private_ipv4(c: Column | str) -> Column:
    """0/8, 10/8, 127/8, 169.254/16, 172.16/12, 192.168/16; false for what is no IPv4 address."""
    parts = F.split(_col(c), r"\.")
    octet = lambda n: F.try_element_at(parts, F.lit(n)).try_cast("int")
    a, b = octet(1), octet(2)
    valid = (F.size(parts) == 4) & F.coalesce(F.forall(parts, lambda p: p.try_cast("int").between(0, 255)), F.lit(False))
    private = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return F.coalesce(valid & private, F.lit(False))


def is_private_ipv6(c: Column | str) -> Column:
    """::, ::1, fe80::/10, fc00::/7 and private IPv4 addresses mapped or embedded; without a zone or brackets."""

    def of(w: Column) -> Column:
        word = lambda n: F.element_at(w, n)
        zero_to = lambda n: F.forall(F.slice(w, 1, n), lambda g: g == 0)
        v4 = F.concat_ws(".", *[x.cast("string") for n in (7, 8) for x in (F.shiftright(word(n), 8), word(n).bitwiseAND(255))])
        embedded = zero_to(5) & word(6).isin(0, 0xFFFF)
        return (zero_to(7) & (word(8) <= 1)) | (word(1).bitwiseAND(0xFFC0) == 0xFE80) | (word(1).bitwiseAND(0xFE00) == 0xFC00) | (embedded & is_private_ipv4(v4))

    return F.coalesce(_let(ipv6_words(F.substring_index(F.regexp_replace(_col(c), r"\A\[|\]\z", ""), "%", 1)), of), F.lit(False))


def private_host(c: Column | str) -> Column:
    """Whether a canonical host is a private address, or a name that only ever means this machine."""
    h = _col(c)
    local = F.regexp_replace(h, r"\.\z", "").rlike(r"(?:\A|\.)localhost\z")
    return is_private_ipv4(h) | local | F.when(h.contains(":"), is_private_ipv6(h)).otherwise(F.lit(False))


def fetch_error(c: Column | str, resolved: Column | None = None) -> Column:
    """Why a URL must not be fetched, or null. ``resolved``: addresses of its host, where they were looked up."""
    u = _col(c)
    looked_up = F.lit(False) if resolved is None else F.coalesce(F.exists(resolved, lambda a: is_private_ipv4(a) | is_private_ipv6(a)), F.lit(False))

    def of(p: _Parts) -> Column:
        checked = _let(p.own_host, lambda host: F.when(host.isNull(), F.concat(F.lit("Invalid URL: "), u)).when(private_host(host) | looked_up, F.lit(PRIVATE_ADDRESS)))
        only = F.when(p.is_web & p.scheme.isin("http", "https"), checked).otherwise(F.lit(ONLY_HTTP))
        return F.when(F.coalesce(p.is_shaped, F.lit(False)), only).otherwise(F.concat(F.lit("Invalid URL: "), u))

    return F.when(F.coalesce(F.length(u), F.lit(0)) == 0, F.lit(URL_REQUIRED)).otherwise(_parted(u, of))
