"""String helpers with Unicode meaning: white space and word characters are
spelled out because Java's ``\\s`` and ``\\w`` are ASCII-only."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every Unicode white-space character, by rule.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_WS_RANGES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{_WS_RANGES}]"
# The nested form lets plain letters match on the first, cheap test.
NOT_WS = rf"[!-\x{{84}}[^{_WS_RANGES}]]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_BEFORE = rf"(?<!{WORD})"
NOT_WORD_NEXT = rf"(?!{WORD})"


def ws_class_without(extra: str) -> str:
    """Class of characters that are neither white space nor in ``extra``."""
    return f"[^{_WS_RANGES}{extra}]"


def fill_pattern(pattern: str) -> str:
    return pattern.replace("NOT_WORD_NEXT", NOT_WORD_NEXT).replace("WS", WS)


def strip(c: Column) -> Column:
    """Remove white space of any kind on both ends (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def closed(df: DataFrame, computed: dict[str, Column], drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with computed columns that no filter is copied into. They pass through a
    generated struct: a filter on any other column goes below it, down to the scan,
    and one on a computed column stays above instead of being rewritten into a copy
    of everything the value is made of."""
    keep = [c for c in df.columns if c not in computed and c not in set(drop)]
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in computed.items()]))).alias("_closed")
    return df.select(*[F.col(f"`{c}`") for c in keep], packed).select(
        *[F.col(f"`{c}`") for c in keep], *[F.col(f"_closed.`{n}`") for n in computed])


def any_of(flags: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def count_of(flags: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, (f.cast("int") for f in flags))


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: Iterable[str]) -> Column:
    """Constant array. Parsed from one text: a plan with hundreds of separate
    literals takes seconds to put together from Python."""
    return F.expr("array(" + ", ".join(sql_string(v) for v in values) + ")")


def one_of(c: Column, values: Iterable[str]) -> Column:
    """Membership in a short list."""
    return F.array_contains(sql_array(values), c)


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """``c`` holds one of ``terms``; for short strings."""
    return F.exists(sql_array(terms), lambda t: c.contains(t))


def count_terms(c: Column, terms: Iterable[str]) -> Column:
    """How many distinct ``terms`` occur in ``c`` as substrings; for short
    strings (long texts: ``count_terms_in``)."""
    return F.size(F.filter(sql_array(terms), lambda t: c.contains(t)))


def count_terms_in(column: str, terms: Iterable[str]) -> Column:
    """The same over a named column as one generated sum."""
    return F.expr(" + ".join(f"cast(contains({column}, {sql_string(t)}) as int)" for t in terms))


def count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def flag(c: Column) -> Column:
    """Unknown never raises a flag."""
    return F.coalesce(c, F.lit(False))
