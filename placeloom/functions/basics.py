"""Column helpers that the other modules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the input's producers see it: ASCII white space, no-break space and the Unicode spaces.
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: ASCII word boundaries (Java's \b follows Unicode letters).
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def truthy(c: Column) -> Column:
    """Present and not empty (strings)."""
    return c.isNotNull() & (c != "")


def nonzero(c: Column) -> Column:
    """Present and not zero (numbers)."""
    return c.isNotNull() & (c != 0)


def half_up(c: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(c + F.lit(0.5))


def rounded(c: Column, places: int) -> Column:
    return half_up(c * float(10**places)) / float(10**places)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a fixed table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
