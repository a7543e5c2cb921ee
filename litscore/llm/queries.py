"""The training-data operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from litscore.llm.ann import nearest
from litscore.llm.common import spread, table
from litscore.llm.counts import count_tokens
from litscore.llm.html import extract
from litscore.llm.jaccard import similar_groups
from litscore.llm.mixing import mix_sources, taken_words
from litscore.llm.neardup import near_duplicates
from litscore.llm.oracle import oracle_sql
from litscore.llm.packing import pack
from litscore.llm.pieces import encode_pieces, piece_digest
from litscore.llm.quality import classify
from litscore.llm.search import rank_documents
from litscore.llm.simple8b import crc, read_ids, write_ids
from litscore.llm.suffix import digest, remove_repeats
from litscore.llm.tokens import tokenizer_path
from litscore.llm.trie import conversation_trie
from litscore.session import scratch_path


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weight takes from each document."""
    mixed = taken_words(*mix_sources(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spread(table(spark, sf_dir, "pages")))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings of a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written in the binary format and read back."""
    path = scratch_path(spark, "simple8b")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return crc(read_ids(spark, path))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without passages of 50 bytes that an earlier one has."""
    return digest(remove_repeats(table(spark, sf_dir, "documents")))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents linked by similar sets of word shingles."""
    return similar_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all embeddings for every row whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of unigram pieces of every document and the score of the best path."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a model fitted on the labels that are not held out."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every whole text, and the text they decode to, as digests."""
    return piece_digest(encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each rebuilt on the first turns of its hundred."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mixing, op2_html, op3_neardup, op4_simple8b, op5_suffix, op6_jaccard, op7_packing, op8_ann, op9_counts, op10_quality, op11_sentencepiece, op12_search, op13_trie)
    return {f.__name__: f for f in found}


__all__ = ["oracle_sql", "queries"]
