"""Text cleaning, leading years, first scalars and article links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"


def strip_text(col: Column) -> Column:
    """Drop white space (Unicode included) at both ends."""
    return F.regexp_replace(col, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def clean_text(col: Column) -> Column:
    """Stripped text; null stays null and text that is only white space is empty."""
    return strip_text(col)


def unwrap_text(col: Column) -> Column:
    """Join hard-wrapped lines with one space each; empty input gives null.

    A blank line inside leaves two spaces, as it is a line like any other.
    """
    lines = F.transform(F.split(strip_text(col), "\n"), strip_text)
    return F.nullif(F.array_join(lines, " "), F.lit(""))


def first_simple(col: Column, depth: int) -> Column:
    """The first scalar of arrays nested ``depth`` deep; null where there is none."""
    for _ in range(depth):
        col = F.get(col, F.lit(0))
    return col


def year_of(col: Column) -> Column:
    """The leading four characters as an integer, null if they are not one."""
    return F.substring(col, 1, 4).try_cast("int")


def year_before_dash(col: Column) -> Column:
    """The part before the first ``-`` as an integer, null if it is not one."""
    return F.substring_index(col, "-", 1).try_cast("int")


def article_url(
    doi: Column | str = "doi", arxiv: Column | str = "arxiv", journal: Column | str = "journal"
) -> Column:
    """Where a reader finds the article: arXiv for journal ``arXiv``, else the DOI."""
    doi, arxiv, journal = (F.col(c) if isinstance(c, str) else c for c in (doi, arxiv, journal))
    return F.when(
        journal.eqNullSafe(F.lit("arXiv")), F.concat(F.lit("https://arxiv.org/abs/"), arxiv)
    ).otherwise(F.concat(F.lit("https://doi.org/"), doi))


def last_segment(col: Column) -> Column:
    """The text after the last ``/``."""
    return F.substring_index(col, "/", -1)
