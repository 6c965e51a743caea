"""Text functions of the style engine as column expressions: exact tokenizers, splitters, counts and rounding.

Patterns are written for Java and avoid what engines read differently: white space is an explicit class (it includes the
no-break space), word borders are ASCII look-arounds, and the end of input is \\z. Null text gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, for use inside brackets; understood by Java and RE2 alike.
WS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same as a set of characters, for the trim functions.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: One such character, for Java only: printable ASCII is told apart before the long class is tried.
SPACE = rf"[\x00-\x20\x7F-\x{{10FFFF}}&&[{WS}]]"
_START, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def starting(term: str) -> str:
    """A term after an ASCII word border. Its first letter is tried before what is behind it: most places end there."""
    first = term[0]
    return f"{first}(?<![A-Za-z0-9_]{first}){term[1:]}" if re.match(r"[A-Za-z](?![?*+{])", term) else _START + term


def ending(term: str) -> str:
    """The border after a term; one after punctuation asks for a word character there."""
    return _END if re.search(r"[A-Za-z0-9_)]$", term) else r"(?=[A-Za-z0-9_])"


def bounded(term: str, case: bool = False) -> str:
    """A pattern for a term between ASCII word borders."""
    return ("" if case else "(?i)") + starting(term) + ending(term)


def by_letter(patterns: list[str]) -> str:
    """One pattern for several that start with a letter, put together by it; of each letter's, earlier ones first."""
    groups: dict[str, list[str]] = {}
    for p in patterns:
        groups.setdefault(p[0].lower(), []).append(p[1:])
    return "(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in groups.items()) + ")"


def within(patterns: list[str]) -> str:
    """A pattern that tells whether a text has one of several, after an ASCII word border and in any case."""
    return rf"(?i)(?:\A|[^A-Za-z0-9_]){by_letter(patterns)}"


def literal_start(term: str) -> str:
    """The plain text, in lower case, that every match of a term begins with."""
    plain = re.match(r"[A-Za-z0-9' _-]*", term)[0]
    return (plain[:-1] if re.match(r"[?*+{]", term[len(plain) :]) else plain).lower()


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c evaluated once however often f reads it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def any_of(terms: list[str]) -> str:
    """One pattern for a list of terms, earlier ones first."""
    letters = "".join(sorted({t[0].lower() for t in terms}))
    return f"(?i)(?=[{letters}])" + _START + by_letter([t + (_END if re.search(r"[A-Za-z0-9_]$", t) else r"(?=[A-Za-z0-9_])") for t in terms])


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def spaced(c: Column) -> Column:
    """The text with every white space as a plain space. Searching bytes costs far less than a pattern does."""
    others = F.array(*[F.lit(x) for x in WS_CHARS if x != " "])
    return F.aggregate(others, c, lambda t, x: F.when(F.contains(t, x), F.replace(t, x, F.lit(" "))).otherwise(t))


def trimmed_start(c: Column, n: int) -> Column:
    """The first n characters of the trimmed text. The end is only trimmed where nothing else follows them, so a long
    text is not searched for it."""

    def cut(t: Column) -> Column:
        more = F.ltrim(F.substr(t, F.lit(n + 1)), F.lit(WS_CHARS)) != ""
        return let(F.left(t, F.lit(n)), lambda x: F.when(more, x).otherwise(F.rtrim(x, F.lit(WS_CHARS))))

    return let(F.ltrim(c, F.lit(WS_CHARS)), cut)


def words(c: Column) -> Column:
    """Lower-case tokens of a-z, 0-9, apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9'-]++"), F.lit(0))


def word_count(c: Column) -> Column:
    """Runs without white space."""

    def count(t: Column) -> Column:
        single = F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
        return F.when(t == "", F.lit(0)).otherwise(let(single, lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1))

    return let(F.btrim(spaced(c), F.lit(" ")), count)


def sentences(c: Column) -> Column:
    """Pieces between white space that follows an end mark: the splitter of the analysis."""
    return F.filter(F.transform(F.split(c, rf"{SPACE}(?<=[.!?](?s:.)){SPACE}*"), trim), lambda x: x != "")


def sentences_kept(c: Column) -> Column:
    """Runs up to and with their end marks: the splitter of rewriting. Leading end marks are lost."""
    parts = F.regexp_extract_all(c, F.lit(r"[^.!?]++(?:[.!?]++|\z)"), F.lit(0))
    return let(parts, lambda p: F.when(F.size(p) == 0, F.array(trim(c))).otherwise(F.filter(F.transform(p, trim), lambda x: x != "")))


def ngrams(tokens: Column, n: int) -> Column:
    """Every n tokens in a row. Tokens are zipped with themselves shifted; a lambda would evaluate them for each place."""
    grams = tokens
    for i in range(1, n):
        grams = F.zip_with(grams, F.slice(tokens, F.lit(i + 1), F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(grams, F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(0)))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def half_up(c: Column, places: int = 0) -> Column:
    """Half towards plus infinity on the binary product; F.round works on the decimal form and differs."""
    f = float(10**places)
    return F.floor(c * f + 0.5) / f


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def decapitalize(c: Column) -> Column:
    return F.concat(F.lower(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def letters(tokens: Column) -> Column:
    """Characters of all tokens without apostrophes."""
    return F.length(F.replace(F.array_join(tokens, ""), F.lit("'"), F.lit(""))).cast("long")


def contraction_label(rate: Column, frequent: float, rare: float) -> Column:
    return F.when(rate >= frequent, "Frequent").when(rate < rare, "Rare").otherwise("Some")


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def settled(df: DataFrame) -> DataFrame:
    """df, with its expressions evaluated once a row: later projections are not folded into them. Else an expression that
    a later lambda or several later columns refer to would be evaluated for each of them."""
    return df.withColumn("_nothing", F.monotonically_increasing_id()).filter(F.col("_nothing") >= 0).drop("_nothing")
