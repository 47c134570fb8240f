"""Text functions as column expressions. White space, lengths and word ends are those of UTF-16 text in browsers and Node."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as the inside of a character class; RE2 and Java read it alike.
SPACE_SET = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{SPACE_SET}]"
#: The same white space, character by character.
SPACES = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD = f"[^{SPACE_SET}]+"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
LETTERS_DIGITS = r"[A-Za-z0-9\x{00C0}-\x{00FF}]"
#: The same, character by character.
LETTERS_DIGITS_SET = string.ascii_letters + string.digits + "".join(map(chr, range(0xC0, 0x100)))
NO_LETTERS_DIGITS = r"[^A-Za-z0-9\x{00C0}-\x{00FF}]++"
#: Whether an ASCII word character comes before, or after; Java's own boundary knows more letters.
NOT_AFTER_WORD, NOT_BEFORE_WORD = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_LETTER = r"[a-zA-Z\x{00C0}-\x{00FF}]"
#: Three letters apart, and a digit alone; they begin at a word boundary.
FRAGMENTS = rf"{_LETTER}{SPACE}+{_LETTER}{SPACE}+{_LETTER}"
LONE_DIGIT = r"\d"

#: Steps of sanitize_text in order: pattern and what takes its place. Fixed values.
SANITIZE_STEPS = (
    (r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", ""),
    (r"[\x{200B}-\x{200F}\x{FEFF}\x{00A0}]", " "),
    (r"[\x{2028}\x{2029}\x{0085}\n\r]", "\n"),
    (ASTRAL, "  "),
    (r"[^\x20-\x7E\x{00A1}-\x{017F}\x{0400}-\x{04FF}\n\r\t]", " "),
    (r"""[!@#$%^&*()_+\-={}\[\]|\\:;"'<>,.?/]{3,}""", " "),
    (SPACE + "{3,}", " "),
    (r"\n{4,}", "\n\n\n"),
)


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def js_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_without(text: Column, others: str) -> Column:
    """How many characters aren't matched by a pattern."""
    return F.length(replace(text, others, "")).cast("long")


def letter_digit_count(text: Column) -> Column:
    """count_without(text, NO_LETTERS_DIGITS), without a match for each run of others."""
    return (F.length(text) - F.length(F.translate(text, LETTERS_DIGITS_SET, ""))).cast("long")


def blank_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def white_count(text: Column) -> Column:
    return (F.length(text) - F.length(replace(text, SPACE + "++", ""))).cast("long")


def word_count(trimmed: Column) -> Column:
    """Words of a text that is trimmed already."""
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE + "++"))).cast("long")


def sanitize(text: Column) -> Column:
    """White space to single spaces, trimmed; null is empty."""
    return F.coalesce(js_trim(replace(text, SPACE + "+", " ")), F.lit(""))


#: What step 5 leaves of SANITIZE_STEPS is none of step 2's characters, and both put a space for each: one step does for both.
_SPACED_BY_TWO = 1


def sanitize_text(text: Column) -> Column:
    """The steps of SANITIZE_STEPS, trimmed; null is empty."""
    for k, (pattern, by) in enumerate(SANITIZE_STEPS):
        if k != _SPACED_BY_TWO:
            text = replace(text, pattern, by)
    return F.coalesce(js_trim(text), F.lit(""))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def trimmed_lines(text: Column, longer_than: int = 0) -> Column:
    """The text's lines, trimmed, that are then longer than so many units."""
    return F.filter(F.transform(lines(text), js_trim), lambda line: line != "" if longer_than == 0 else js_length(line) > longer_than)


def repetition(of_lines: Column) -> Column:
    """The share of lines that repeat another; 0 without lines. It reads its argument several times, so that should be a column set out before."""
    n = F.size(of_lines)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.size(F.array_distinct(of_lines))) / n)


#: FRAGMENTS at a word boundary: an ASCII letter begins a word, and another letter is none of it, so it ends one.
_FRAGMENTS_AT_BOUNDARY = rf"(?:{NOT_AFTER_WORD}[a-zA-Z]|(?<=[A-Za-z0-9_])[\x{{00C0}}-\x{{00FF}}]){SPACE}+{_LETTER}{SPACE}+{_LETTER}"
_LONE_DIGIT_AT_BOUNDARIES = rf"{LONE_DIGIT}(?<![A-Za-z0-9_]{LONE_DIGIT}){NOT_BEFORE_WORD}"


def fragment_count(text: Column) -> Column:
    return count(text, _FRAGMENTS_AT_BOUNDARY)


def lone_digit_count(text: Column) -> Column:
    return count(text, _LONE_DIGIT_AT_BOUNDARIES)


def is_redundant_sidecar(text: Column) -> Column:
    """Whether a side file says nothing but its placeholder."""
    return F.upper(js_trim(text)) == "TEXTO"


def natural_order(name: Column) -> Column:
    """A sort key in which page-2 comes before page-10, by each run of digits of a name and without case; the name itself parts what is left."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def key(part: Column) -> Column:
        digits = part.rlike(r"^\d")
        number = F.ltrim(part, F.lit("0"))
        return F.struct((~digits).alias("is_text"), F.when(digits, F.length(number)).alias("size"), F.when(digits, number).otherwise(F.lower(part)).alias("part"))

    return F.struct(F.transform(parts, key).alias("parts"), name.alias("name"))
