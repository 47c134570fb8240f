"""URL functions as column expressions: the normal form of a URL, and its query hidden."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_SET

#: A hierarchical URL: scheme, login, host, port, path, query, fragment. Host and scheme are read without case.
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s\[\]\\]+)(?::(\d*))?((?:[/\\][^?#]*)?)(\?[^#]*)?(#.*)?$"
#: Fixed values.
REDACTED_QUERY, INVALID_URL = "[redacted-query]", "[invalid-url]"
#: Schemes whose URLs always have a host and a path, and the ports that they have if none is told. Fixed values.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
#: What is written by its bytes in a path, a login and a fragment, and what no host may hold.
IN_PATH = r'[\x00-\x20"#<>?`{}\x7f-\x{10FFFF}]'
IN_LOGIN = r'[\x00-\x20"#<>?`{}/:;=@\[\\\]^|\x7f-\x{10FFFF}]'
IN_FRAGMENT = r'[\x00-\x20"<>`\x7f-\x{10FFFF}]'
NOT_IN_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), computing value once though it is used often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def percent_encoded(text: Column, kinds: str) -> Column:
    """Characters of some kinds as percent signs and the bytes that they have in UTF-8."""
    by_bytes = lambda c: F.when(c.rlike(kinds), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(text.rlike(kinds), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), by_bytes), "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path that begins with a slash without the parts . and .., however they are written: .. takes the part before it away."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)

    def fold(parts: Column) -> Column:
        named = F.transform(parts, lambda s, i: F.struct(F.replace(F.lower(s), F.lit("%2e"), F.lit(".")).alias("kind"), s.alias("s"), (i == F.size(parts) - 1).alias("last")))
        none = F.array().cast("array<string>")
        empty = lambda s: F.when(s["last"], F.array(F.lit(""))).otherwise(none)  # noqa: E731  a folder keeps its slash
        up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        step = lambda acc, s: F.when(s["kind"] == "..", F.concat(up(acc), empty(s))).when(s["kind"] == ".", F.concat(acc, empty(s))).otherwise(F.concat(acc, F.array(s["s"])))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(named, none, step), "/"))

    return F.when(path.rlike(r"(?i)/(\.|%2e)"), _once(parts, fold)).otherwise(path)


def punycode(label: Column) -> Column:
    """A label with characters beyond ASCII in Punycode (RFC 3492), without its prefix.

    Characters beyond ASCII go in order of code point and place. How far one is from the one before it is a number in variable-length digits;
    the thresholds of these depend on the number before alone, so nothing is carried from one to the next.
    """

    def label_of(cps: Column) -> Column:
        basic = F.filter(cps, lambda x: x["c"] < 128)
        return _once(F.array_sort(F.filter(cps, lambda x: x["c"] >= 128)), lambda rest: encoded(cps, basic, rest))

    def encoded(cps: Column, basic: Column, rest: Column) -> Column:
        n = F.size(basic)
        place = lambda x: F.size(F.filter(cps, lambda y: (y["p"] < x["p"]) & (y["c"] <= x["c"])))
        before = lambda i: F.get(rest, i - 1)
        delta = lambda x, i: (
            (x["c"] - F.when(i == 0, 128).otherwise(before(i)["c"])) * (n + i + 1) + place(x) - F.when(i == 0, 0).otherwise(place(before(i)) + 1)
        ).cast("long")
        return _once(F.transform(rest, delta), lambda deltas: written(basic, n, deltas))

    def written(basic: Column, n: Column, deltas: Column) -> Column:
        digits = F.transform(deltas, lambda d, i: number(d, F.when(i == 0, F.lit(72).cast("long")).otherwise(bias(F.get(deltas, i - 1), n + i, i == 1))))
        return F.concat(F.array_join(F.transform(basic, lambda x: F.char(x["c"])), ""), F.when(n > 0, "-").otherwise(""), F.array_join(digits, ""))

    def bias(delta: Column, points: Column, first: Column) -> Column:
        d = F.floor(delta / F.when(first, 700).otherwise(2))

        def adapted(d: Column) -> Column:
            least = F.lit(4)
            for j in (3, 2, 1, 0):
                least = F.when(F.floor(d / 35**j) <= 455, j).otherwise(least)
            return _once(least, lambda j: _once(F.floor(d / F.pow(F.lit(35), j)), lambda x: 36 * j + F.floor(36 * x / (x + 38))))

        return _once(d + F.floor(d / points), adapted)

    def number(delta: Column, bias: Column) -> Column:
        state = F.struct(delta.alias("q"), F.lit("").alias("s"))

        def step(st: Column, k: Column) -> Column:
            t = F.least(F.greatest(36 * k - bias, F.lit(1)), F.lit(26))
            digit = lambda d: F.substring(F.lit(DIGITS), d.cast("int") + 1, F.lit(1))
            last = F.struct(F.lit(-1).cast("long").alias("q"), F.concat(st["s"], digit(st["q"])).alias("s"))
            more = F.struct(F.floor((st["q"] - t) / (36 - t)).cast("long").alias("q"), F.concat(st["s"], digit(t + (st["q"] - t) % (36 - t))).alias("s"))
            return F.when(st["q"] < 0, st).when(st["q"] < t, last).otherwise(more)

        return F.aggregate(F.sequence(F.lit(1), F.lit(9)), state, step, lambda st: st["s"])

    chars = F.transform(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), lambda c, i: F.struct(F.ascii(c).alias("c"), i.alias("p")))
    return _once(chars, label_of)


def _raw(url: Column, use: Callable[[Column], Column]) -> Column:
    """use of the parts of a URL as they are written, without control characters and spaces around it, and line ends and tabs within."""
    clean = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    names = ("scheme", "login", "host", "port", "path", "query", "fragment")
    return _once(clean, lambda c: _once(F.struct(*[(F.lower(x) if n == "scheme" else x).alias(n) for k, n in enumerate(names, 1) for x in [F.regexp_extract(c, URL, k)]]), use))


def _port(r: Column) -> Column:
    """Without leading zeros; empty where the scheme says it."""
    port = F.regexp_replace(r["port"], r"^0+(\d)", "$1")
    plain = (port == "") | F.coalesce(*[F.when((r["scheme"] == s) & (port == p), True) for s, p in DEFAULT_PORTS.items()], F.lit(False))
    return F.when(plain, "").otherwise(F.concat(F.lit(":"), port))


def _host(r: Column) -> Column:
    """In lower case, percent signs read, labels beyond ASCII in Punycode; null where it holds what no host may."""
    beyond = r"[^\x00-\x7f]"
    raw = r["host"]

    def named(read: Column) -> Column:
        labels = F.split(F.regexp_replace(read, "[。．｡]", "."), r"\.")
        coded = F.array_join(F.transform(labels, lambda x: F.when(x.rlike(beyond), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)), ".")
        return F.when(read.rlike(beyond), coded).otherwise(read)

    read = F.lower(F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw))
    return _once(_once(read, named), lambda host: F.when(host.startswith("[") | ~host.rlike(NOT_IN_HOST), host))


def _path(r: Column) -> Column:
    special = r["scheme"].isin(*DEFAULT_PORTS)
    path = F.when(special, F.replace(r["path"], F.lit("\\"), F.lit("/"))).otherwise(r["path"])
    return F.when(special & (path == ""), "/").otherwise(_once(_once(path, without_dots), lambda p: percent_encoded(p, IN_PATH)))


def _login(r: Column) -> Column:
    user, word = F.substring_index(r["login"], ":", 1), F.when(r["login"].contains(":"), F.regexp_replace(r["login"], "^[^:]*:", "")).otherwise("")
    told = F.concat(percent_encoded(user, IN_LOGIN), F.when(word == "", "").otherwise(F.concat(F.lit(":"), percent_encoded(word, IN_LOGIN))))
    return F.when(told == "", "").otherwise(F.concat(told, F.lit("@")))


def redact_url(url: Column) -> Column:
    """The URL in its normal form with its query hidden. Without a query it keeps its login; with one it loses it.

    Normal form: scheme and host in lower case, the host in Punycode, no port that the scheme says, no . and .. in the path, and characters that may
    not stand there by their bytes. Hosts are lowered character by character, without the compatibility mapping of international names, and numeric
    ones aren't read as addresses.
    """

    def told(r: Column) -> Column:
        port = (r["port"] == "") | (F.coalesce(r["port"].try_cast("long"), F.lit(1 << 20)) < 65536)
        parts = F.struct(_host(r).alias("host"), _port(r).alias("port"), _path(r).alias("path"), _login(r).alias("login"), percent_encoded(r["fragment"], IN_FRAGMENT).alias("fragment"))
        return F.when((r["scheme"] != "") & port, _once(parts, lambda p: written(r, p)))

    def written(r: Column, p: Column) -> Column:
        origin, host = F.concat(r["scheme"], F.lit("://")), F.concat(p["host"], p["port"])
        plain = F.concat(origin, p["login"], host, p["path"], F.when(r["query"] == "?", "?").otherwise(""), p["fragment"])
        hidden = F.concat(origin, host, p["path"], F.lit("?" + REDACTED_QUERY), F.when(p["fragment"] == "#", "").otherwise(p["fragment"]))
        return F.when(F.length(r["query"]) <= 1, plain).otherwise(hidden)

    return F.coalesce(_raw(url, told), F.lit(INVALID_URL))


def redact_urls_in(message: Column) -> Column:
    """Every http or https URL within a message redacted. Matches and what lies between them are put together again in order."""
    pattern = rf"https?://[^{SPACE_SET}]+"
    found = F.regexp_extract_all(message, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(message, pattern)
    whole = F.zip_with(between, found, lambda text, url: F.concat(text, F.coalesce(F.when(url.isNotNull(), redact_url(url)), F.lit(""))))
    return F.when(message.rlike(pattern), F.array_join(whole, "")).otherwise(message)


def basename(url: Column) -> Column:
    """The last part of a URL's path, percent signs as they are; trailing slashes don't count."""
    return F.element_at(F.split(F.regexp_replace(_raw(url, _path), "/+$", ""), "/"), -1)
