"""A corpus pipeline over ``documents``; each stage is stored and read again by the next.

Stages take (spark, docs, sf_dir) and return the columns of ``documents`` (doc_id, text,
lang, source, n_chars and any others), but for the last, which returns packed pieces. An
empty table gives an empty result; null and empty texts are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litscore.llm.common import free_name, store, table
from litscore.llm.jaccard import similar_groups
from litscore.llm.mixing import mixed_documents
from litscore.llm.packing import pack
from litscore.llm.quality import THRESHOLD, fit_quality, score_quality
from litscore.llm.suffix import remove_repeats
from litscore.llm.tokens import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    weights = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score")
    return score_quality(docs, weights, score).filter(F.col(score) >= THRESHOLD).drop(score)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest doc_id.

    Documents without doc_id or without words are in no group and stay.
    """
    groups = similar_groups(docs)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has.

    A character cut in two goes whole. Documents of which nothing is left go; n_chars is
    counted anew. Documents that lose nothing stay as they are.
    """

    others = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(docs, tuple(others)).select("carried", "n_removed", "kept")
    schema = cut.select("carried", "n_removed", F.lit("").alias("kept")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
            columns = [batch.column("carried"), batch.column("n_removed"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["carried", "n_removed", "kept"])

    lost = F.col("n_removed") > 0
    columns = {
        "text": F.when(~F.col("carried.no_text"), F.col("kept")),
        "n_chars": F.when(lost, F.length("kept").cast("bigint")).otherwise(F.col("carried.n_chars")),
    }
    return (
        cut.mapInArrow(decode, schema)
        .filter(~lost | (F.col("kept") != ""))
        .select(*(columns.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix by source weights takes from it."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("jaccard", jaccard_stage),
    ("suffix", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages fit a model, hash, sort suffixes and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
