"""Cleaning, lookup and shortening of text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from freightlens.schema import NA_TOKENS


def null_tokens(c: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """Null where the text is one of ``tokens``."""
    return F.when(~c.isin(*tokens), c) if tokens else c


# The characters that count as whitespace around a field.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove all surrounding whitespace."""
    return F.trim(c, F.lit(WHITESPACE))


def trim_to_null(c: Column) -> Column:
    """Strip surrounding whitespace; null for what is then blank or ``nan``."""
    stripped = strip(c)
    return F.when(~stripped.isin("", "nan"), stripped)


def lookup(c: Column, names: Mapping[str, str]) -> Column:
    """Literal dictionary lookup; null for an unknown or null key."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), c)


def shorten(c: Column, n: int, suffix: str = "") -> Column:
    """First ``n`` characters, with ``suffix`` only where something was cut."""
    head = F.substring(c, 1, n)
    if not suffix:
        return head
    return F.when(F.length(c) > n, F.concat(head, F.lit(suffix))).otherwise(c)


def field_count(record: Column) -> Column:
    """Number of CSV fields in the text of one record, quotes respected.

    Escaped quotes go first, so what is left of a quoted field is one simple
    run. A comma in front lets the pattern start with a literal, which the regex
    engine finds fast.
    """
    return F.size(F.split(_without_quoted(record), ",", -1)) - 1


def _without_quoted(record: Column) -> Column:
    unescaped = F.replace(record, F.lit('""'), F.lit(""))
    return F.regexp_replace(F.concat(F.lit(","), unescaped), ',"[^"]*"', ",")


def ends_open(line: Column) -> Column:
    """A line of CSV text ends within a quoted field. A quote inside of an unquoted one is text."""
    return F.contains(_without_quoted(line), F.lit(',"'))


def file_name(uri_name: Column, codec: str = "") -> Column:
    """Plain name of a file from its URI-encoded one, without the suffix of ``codec``."""
    name = F.try_url_decode(F.replace(uri_name, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, rf"\.{codec}$", "") if codec else name
