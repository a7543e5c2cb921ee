"""Row filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CREATED = "created (Read-Only)"


def filter_library_since(
    df: DataFrame, day: str, inclusive: bool = True, column: str = CREATED
) -> DataFrame:
    """Library rows created on or after ``day``, compared as strings."""
    created = F.col(f"`{column}`")
    return df.filter(created >= F.lit(day) if inclusive else created > F.lit(day))


def require_title(df: DataFrame) -> DataFrame:
    """Rows with a title."""
    return df.filter(F.col("title").isNotNull())


def require_complete(df: DataFrame) -> DataFrame:
    """Rows with a title and an abstract."""
    return df.filter(F.col("title").isNotNull() & F.col("abstract").isNotNull())


def match_filter(scored: DataFrame, threshold: float = 0.08) -> DataFrame:
    """Rows nearer to the library than ``threshold``, strictly."""
    return scored.filter(F.col("distance") < F.lit(float(threshold)))


def split_by_id_kind(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with a DOI; of the rest, those with an arXiv id; and those with a url.

    A row without a DOI that has both is in both.
    """
    rest = df.filter(F.col("doi").isNull())
    return (
        df.filter(F.col("doi").isNotNull()),
        rest.filter(F.col("arxiv").isNotNull()),
        rest.filter(F.col("url").isNotNull()),
    )


def encoder_input(df: DataFrame, sep: str = "[SEP]") -> DataFrame:
    """Add ``input``: title, separator, abstract. A missing abstract becomes empty.

    A missing title gives a null input.
    """
    return df.withColumn("abstract", F.coalesce("abstract", F.lit(""))).withColumn(
        "input", F.concat(F.col("title"), F.lit(sep), F.col("abstract"))
    )


def drop_vectors(df: DataFrame) -> DataFrame:
    """Everything but the vector, for reports."""
    return df.drop("embedding")
