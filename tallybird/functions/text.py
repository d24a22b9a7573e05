"""String normalisation that matches what the raw data needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _letters_and_spaces(col: Column) -> Column:
    return col.rlike(r"\A[A-Za-z ]*\z")


def strip_whitespace(col: Column) -> Column:
    """Remove leading and trailing whitespace of every kind; ``trim`` only removes spaces. It is enough
    for texts of plain letters and spaces, which need no replacement."""
    return F.when(_letters_and_spaces(col), F.trim(col)).otherwise(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def title_case(col: Column) -> Column:
    """Capitalise each run of letters: ``o'brien st-john`` -> ``O'Brien St-John``.

    ``initcap`` alone only looks at whitespace, so it is applied per run, except to texts of plain
    letters and spaces.
    """
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    by_run = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(_letters_and_spaces(col), F.initcap(col)).otherwise(by_run)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
