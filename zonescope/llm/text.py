"""What the operators share: words, document keys and names of working columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a stretch without the six ASCII white-space characters (a fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space for bytes, and the bytes that go on a UTF-8 character.
SPACE = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def own(name: str) -> str:
    """The name of a working column, apart from what tables are likely to hold."""
    return f"__zs_{name}"


def exact(left: Column, right: Column) -> Column:
    """Equal, with null equal to null."""
    return left.eqNullSafe(right)
