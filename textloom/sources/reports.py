"""Reports: a small result as Markdown."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_row(df: DataFrame) -> Column:
    """df's columns as a row of a Markdown table: bars escaped, line ends as blanks, nulls as a dash."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), "\\s*\\n\\s*", " "), F.lit("-"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))


def markdown_table(df: DataFrame, most: int = 1_000) -> str:
    """The table of an aggregate of at most so many rows, in df's order; more is an error, as a report is for people."""
    rows = [r[0] for r in df.select(markdown_row(df)).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + "-|" * len(df.columns), *rows])
