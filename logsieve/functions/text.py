"""Character classes and small text helpers shared by the expressions.

The classes are spelled out with Unicode properties instead of ``\\d``/``\\w``/``\\s``: the shorthand
forms are ASCII-only in Java, while the log tools this library stands in for treat them as Unicode.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

DIGIT = r"\p{Nd}"
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = f"[{WORD_CHARS}]"
SPACE = f"[{SPACE_CHARS}]"
# A word boundary that agrees with WORD (Java's own \b follows another definition of a word).
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


# The white space characters, as a list for trimming (SPACE is the same set as a class).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.trim(col, F.lit(SPACES))


def contains_any(col: Column, needles: list[str]) -> Column:
    """True where ``col`` contains one of ``needles``.

    A needle that itself contains another needle can never decide the answer and is left out.  A long
    list becomes one search for any of the quoted needles, which keeps the generated code small.
    """
    decisive = [n for n in needles if not any(o != n and o in n for o in needles)]
    if len(decisive) > 8:
        return col.rlike("|".join(rf"\Q{n}\E" for n in decisive))
    return reduce(or_, [col.contains(n) for n in decisive])


def lookup(table: dict[str, int | str]) -> Column:
    """A small constant map column."""
    return F.expr(f"map({', '.join(repr(x) for item in table.items() for x in item)})")


def stable_bucket(col: Column, buckets: int = 1000) -> Column:
    """Hash bucket that is the same in every session and engine, so fitted models can be reused."""
    return (hash_number(col) % buckets).cast("int")


def hash_number(col: Column) -> Column:
    """The first 32 bits of the MD5 digest."""
    return F.conv(F.left(F.md5(col), F.lit(8)), 16, 10).cast("long")
