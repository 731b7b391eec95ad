"""Word expressions over the six ASCII white-space characters (space, and tab to carriage return)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words.
BLANKS = "[\\x20\\x09-\\x0D]"


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; null and empty texts have none.

    A split at runs of blanks has one piece more than it has runs; an empty first or last piece is
    no word.
    """
    blank = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
    first = F.substring(text, 1, 1).isin(blank).cast("int")
    last = F.right(text, F.lit(1)).isin(blank).cast("int")
    pieces = F.size(F.split(text, BLANKS + "+", -1))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - first - last).cast("long")
