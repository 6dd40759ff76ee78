"""Books as plain text: what lies between the marks of their beginning and end."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def body(text: Column, start: str = "*** START OF", end: str = "*** END OF") -> Column:
    """Text after the line of the start mark and before the end mark; a missing mark leaves that side whole."""
    first = F.instr(text, start)
    after = F.when(first > 0, F.regexp_replace(F.substring(text, first, F.length(text)), r"^[^\n]*\n?", "")).otherwise(text)
    last = F.instr(after, end)
    return F.trim(F.when(last > 0, F.substring(after, F.lit(1), last - 1)).otherwise(after))
