"""Secret scans: known patterns, and a battery of randomness tests on long tokens with length-aware false-discovery control."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name, kept

#: Patterns of the base scan; of an assignment the value needs six characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What may hold an encoded random string: a whole run of such characters.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: What is tested of a run that no encoding fits: its parts between + / - _ that are long enough.
PART = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"
KINDS = ("assign", "access", "hex", "random")

#: Encodings in the order in which they are inferred: what a token must match, the alphabet in order, and how many bits a token must
#: have at its alphabet's size: fewer are too few to tell, and a word's letters of one case look random for longer.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS, 80.0),
    (r"^[a-z]+$", _LOWER, 150.0),
    (r"^[A-Z]+$", _UPPER, 150.0),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef", 80.0),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 80.0),
    (r"^[A-Z2-7]+$", _UPPER + "234567", 80.0),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER, 80.0),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER, 80.0),
    (r"^[A-Za-z]+$", _UPPER + _LOWER, 80.0),
    (r"^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS, 80.0),
    (r"^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 80.0),
    (r"^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_", 80.0),
)
_FITS = "|".join(pattern for pattern, _, _ in ENCODINGS)
#: Of the tokens dismissed as not random, the share that are random is held below this in each band of lengths.
FALSE_DISCOVERIES = 0.01
#: Matches of a text whose places are summed at a time.
BLOCK = 128
#: p-values are counted in bins, BINS to a power of ten, down to 10**-LEAST_POWER.
BINS, LEAST_POWER = 20, 12


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which stands in the expression once however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(all_: Column) -> Column:
    """An array cut into arrays of BLOCK elements; an empty one gives an empty one."""
    last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
    return F.when(F.size(all_) == 0, F.slice(F.array(all_), F.lit(1), F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK))))


def _spans(text: Column, pattern: str) -> Column:
    """array of (start, end, match): the leftmost matches that don't overlap, in code points. The gaps before them carry the offsets.

    Lengths are summed in blocks of BLOCK matches, and blocks are put one after another, so that no match is copied for each of those after it.
    """
    both = rf"(?s)(.*?)({pattern}|\z)"
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(both), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(both), F.lit(2)).alias("match"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

    def size(piece: Column) -> Column:
        return F.char_length(piece["gap"]) + F.char_length(piece["match"])

    def begun(parts: Column) -> Column:
        """Each block with the place where it begins."""
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
        total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda n, piece: n + size(piece))
        places = F.aggregate(parts, zero, lambda state, part: F.struct((state["at"] + total(part)).alias("at"), F.concat(state["all"], F.array(state["at"])).alias("all")), lambda state: state["all"])
        return F.arrays_zip(parts.alias("part"), places.alias("at"))

    def placed(block: Column) -> Column:
        def add(state: Column, piece: Column) -> Column:
            begin = state["at"] + F.char_length(piece["gap"])
            span = F.struct(begin.alias("start"), (begin + F.char_length(piece["match"])).alias("end"), piece["match"].alias("match"))
            return F.struct((state["at"] + size(piece)).alias("at"), F.when(piece["match"] == "", state["found"]).otherwise(F.concat(state["found"], F.array(span))).alias("found"))

        return F.aggregate(block["part"], F.struct(block["at"].alias("at"), none.alias("found")), add, lambda state: state["found"])

    found = _let(pieces, lambda all_: _let(_blocks(all_), lambda parts: F.flatten(F.transform(begun(parts), placed))))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _tail(z: Column, t: Column) -> Column:
    """The normal probability above z, by a rational approximation of the error function that is within 1.5e-7; t is _scaled(z)."""
    half = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z / 2)
    return F.greatest(F.when(z >= 0, half).otherwise(1 - half), F.lit(10.0**-LEAST_POWER))


def _scaled(z: Column) -> Column:
    return 1 / (1 + 0.3275911 * F.abs(z) / F.sqrt(F.lit(2.0)))


def tested(spans: Column) -> Column:
    """array of (start, end, band, bin) of token spans, or of their parts where no encoding fits, that are long enough: band is the power of two of
    the length, bin tells how improbable the token would be if its characters were drawn evenly and independently."""
    def alphabet(t: Column) -> Column:
        found = F.lit(None).cast("struct<letters:string,least:double>")
        for pattern, letters, least in reversed(ENCODINGS):
            found = F.when(t.rlike(pattern), F.struct(F.lit(letters).alias("letters"), F.lit(least).alias("least"))).otherwise(found)
        return found

    def encoding(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("t"), alphabet(s["match"]).alias("e"))

    def inferred(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["t"].alias("t"), s["e"]["letters"].alias("a"))

    def counted(s: Column) -> Column:
        k, n = F.length(s["a"]).cast("double"), F.length(s["t"]).cast("double")
        of = F.transform(F.sequence(F.lit(1), F.length(s["a"])), lambda i: (n - F.length(F.replace(s["t"], F.substring(s["a"], i, F.lit(1)), F.lit("")))))
        squares = F.aggregate(of, F.lit(0.0), lambda x, c: x + c * c)
        places = F.transform(F.split(s["t"], ""), lambda c: F.instr(s["a"], c).cast("double") - (k + 1) / 2)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), n.alias("n"), k.alias("k"), squares.alias("squares"), places.alias("x"))

    def measured(s: Column) -> Column:
        x, n = s["x"], s["n"]
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct((a * b).alias("p"), ((a > 0) != (b > 0)).cast("double").alias("turn")))
        total = lambda f: F.aggregate(x, F.lit(0.0), lambda y, v: y + f(v))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            n.alias("n"),
            s["k"].alias("k"),
            s["squares"].alias("squares"),
            total(lambda v: v).alias("sum"),
            total(lambda v: v * v).alias("sum2"),
            total(lambda v: (v > 0).cast("double")).alias("high"),
            F.aggregate(pairs, F.lit(0.0), lambda y, p: y + p["p"]).alias("lag"),
            (F.aggregate(pairs, F.lit(0.0), lambda y, p: y + p["turn"]) + 1).alias("runs"),
        )

    def scored(s: Column) -> Column:
        """The three statistics, each about normal for a random token. Steps follow one another so that no value is written out more than once."""
        n, k, high = s["n"], s["k"], s["high"]
        expected = 2 * high * (n - high) / n + 1
        mean = s["sum"] / n
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), n.alias("n"), ((s["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))).alias("chi"),
            high.alias("high"), s["runs"].alias("runs"), expected.alias("expected"), s["lag"].alias("lag"), mean.alias("mean"), (s["sum2"] / n).alias("square"),
        )

    def centred(s: Column) -> Column:
        n, expected = s["n"], s["expected"]
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        runs = F.when((s["high"] == 0) | (s["high"] == n), F.lit(10.0)).otherwise((s["runs"] - expected) / spread)
        own = s["mean"] * s["mean"]
        serial = ((s["lag"] / (n - 1) - own) / F.greatest(s["square"] - own, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), n.alias("n"), s["chi"].alias("chi"), F.abs(runs).alias("runs"), F.abs(serial).alias("serial"))

    def tails(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n"), *(x.alias(name) for z in ("chi", "runs", "serial") for name, x in ((z, s[z]), (f"{z}_t", _scaled(s[z])))))

    def combined(s: Column) -> Column:
        """Fisher's sum of the three tests' p-values: for a random token it is chi-squared with six degrees, halved here."""
        both = lambda z: F.least(2 * _tail(s[z], s[f"{z}_t"]), F.lit(1.0))
        half = -(F.ln(_tail(s["chi"], s["chi_t"])) + F.ln(both("runs")) + F.ln(both("serial")))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n"), half.alias("x"))

    def judged(s: Column) -> Column:
        p = F.least(F.greatest(F.exp(-s["x"]) * (1 + s["x"] + s["x"] * s["x"] / 2), F.lit(10.0**-LEAST_POWER)), F.lit(1.0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.floor(F.log2(s["n"])).cast("int").alias("band"), F.floor(-F.log10(p) * BINS).cast("int").alias("bin"))

    def parts(s: Column) -> Column:
        moved = F.transform(_spans(s["match"], PART), lambda m: F.struct((s["start"] + m["start"]).alias("start"), (s["start"] + m["end"]).alias("end"), m["match"].alias("match")))
        return F.when(s["match"].rlike(_FITS), F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))).otherwise(moved)

    found = F.filter(F.transform(F.flatten(F.transform(spans, parts)), encoding), lambda s: F.length(s["t"]) * F.log2(F.length(s["e"]["letters"]).cast("double")) >= s["e"]["least"])
    for step in (inferred, counted, measured, scored, centred, tails, combined, judged):
        found = F.transform(found, step)
    return found


def dismissed(tokens: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each band of lengths the least bin whose tokens are dismissed as not random, by Benjamini and Hochberg's rule.

    tokens: (band, bin). Sorted p-values become counts in bins: bin b is dismissed if its largest p-value is at most
    false_discoveries times the share of tokens in bins from b on. The table that comes to the driver has a row for each band: 32 at most.
    """
    bins = kept(tokens.groupBy("band", "bin").agg(F.count("*").alias("n")))
    upto = bins.alias("a").join(bins.alias("b"), (F.col("a.band") == F.col("b.band"))).groupBy("a.band", "a.bin").agg(
        F.sum(F.when(F.col("b.bin") >= F.col("a.bin"), F.col("b.n")).otherwise(0)).alias("here"), F.sum("b.n").alias("all")
    )
    low = upto.where(F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS))) <= F.lit(false_discoveries) * F.col("here") / F.col("all"))
    return {r["band"]: r["bin"] for r in low.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def _limit(bound: dict[int, int], band: Column) -> Column:
    """The bin from which on tokens of a band are dismissed; beyond all bins where none is."""
    limit = F.lit(BINS * LEAST_POWER + 1)
    for b, at in sorted(bound.items()):
        limit = F.when(band == b, F.lit(at)).otherwise(limit)
    return limit


def scan_secrets(docs: DataFrame, text_col: str = "text", false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """docs with spans: array of (start, rank, kind, end) in order, offsets in code points, end exclusive.

    Kinds assign, access and hex are the base patterns' leftmost matches. Kind random adds tokens of 20 characters or more that fit an
    encoding, or are part of a run that none fits, have bits enough for it, aren't dismissed by the randomness tests, and don't overlap a base span. What
    is controlled is the loss: of the tokens dismissed in a band of lengths, at most false_discoveries are random ones. A token
    that the tests can't tell from a random one is reported, be it a secret or not. A null or
    empty text has no spans. Repeated rows get the same spans, and count as often as they come in the false-discovery control. A column
    of docs called spans is replaced.
    """
    docs = docs.drop("spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, tokens, blocked = free_name(docs, "base_"), free_name(docs, "tokens_"), free_name(docs, "blocks_")
    found = docs.withColumn(tokens, tested(_spans(text, TOKEN)))
    bound = dismissed(found.where(F.size(tokens) > 0).select(F.explode(tokens).alias("t")).select("t.band", "t.bin"), false_discoveries)

    def as_kind(spans: Column, kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    assigned = F.filter(_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN_VALUE, 1)) >= 6)
    known = F.sort_array(F.concat(as_kind(assigned, "assign"), as_kind(_spans(text, ACCESS), "access"), as_kind(_spans(text, HEX), "hex")))
    ends = lambda part: F.transform(part, lambda b: b["end"])
    blocks = F.transform(_blocks(F.col(base)), lambda part: F.struct(part[0]["start"].alias("low"), F.array_max(ends(part)).alias("high"), part.alias("part")))
    told = found.withColumn(base, known).withColumn(blocked, blocks)

    def random(s: Column, near: Column) -> Column:
        meets = lambda part: F.exists(part, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
        met = F.exists(near, lambda b: F.when((b["low"] < s["end"]) & (b["high"] > s["start"]), meets(b["part"])).otherwise(False))
        return F.when(s["bin"] < _limit(bound, s["band"]), ~met).otherwise(False)

    # the blocks are bound once: within the filter they would be made anew for each token
    left = _let(F.col(blocked), lambda near: F.filter(tokens, lambda s: random(s, near)))
    return told.select(*docs.columns, F.sort_array(F.concat(F.col(base), as_kind(left, "random"))).alias("spans"))
