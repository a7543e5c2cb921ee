"""Ranked lexical search of documents by Block-Max MaxScore over doc-sharded indexes.

Corpus statistics (documents with terms, all terms, document frequencies of the query
terms) are aggregates of Spark. Each partition of the documents is a shard: it builds, for
the query terms only, posting lists in doc_id order with each posting's impact
(1e9 tf) div (1000 tf + 8 m), and the maximum impact of every block of ``BLOCK`` postings.
An item's terms are ordered by their global bound (weight times largest impact); walking
the shard in windows of doc_ids, the terms whose summed bounds cannot beat the item's
current tenth score are non-essential: candidates come from the essential lists only,
their bound with the block maxima of the non-essential lists rejects most of them before
those lists are looked into, and the rest are scored exactly. Each shard keeps a heap of
ten per item; the heaps are merged by a window per item.

Items come in blocks of at most ``QUERY_TERMS`` distinct (item, term) pairs; every block is
one pass over all documents, so no query set is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litscore.llm.common import spread

# Fixed values of the contract: the pattern of a term and the constants of the score.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TERM_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())
TOP = 10
#: Postings per block of block maxima, documents per window of the walk.
BLOCK, WINDOW = 128, 4096
#: (item, term) pairs of one pass over the documents; the weights of a block are broadcast.
QUERY_TERMS = 100_000


def terms(text: F.Column) -> F.Column:
    """Terms of a text column: A-Z lower-cased, maximal runs of the term pattern; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(TERM), 0)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Shard:
    """Posting lists of the query terms over the documents of one partition, in doc_id order."""

    def __init__(self, doc_ids: np.ndarray, term_of: np.ndarray, doc_of: np.ndarray, tf: np.ndarray, lengths: np.ndarray,
                 n_docs: int, n_terms: int, vocabulary: int) -> None:
        order = np.argsort(doc_ids, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.doc_ids = doc_ids[order]
        m = 10 + (90 * lengths[order] * n_docs) // max(n_terms, 1)
        doc = rank[doc_of]
        by = np.lexsort((doc, term_of))
        self.term, self.doc, self.impact = term_of[by], doc[by], impacts(tf[by], m[doc[by]])
        self.starts = np.searchsorted(self.term, np.arange(vocabulary + 1))
        self.block_max, self.block_last, self.block_starts, self.top = [], [], [0], np.zeros(vocabulary, np.int64)
        for t in range(vocabulary):
            a, b = self.starts[t], self.starts[t + 1]
            if a == b:
                self.block_max.append(np.zeros(0, np.int64))
                self.block_last.append(np.zeros(0, np.int64))
                continue
            cuts = np.arange(a, b, BLOCK)
            self.block_max.append(np.maximum.reduceat(self.impact[a:b], cuts - a))
            self.block_last.append(self.doc[np.minimum(cuts + BLOCK, b) - 1])
            self.top[t] = self.block_max[-1].max()

    def postings(self, t: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[t], self.starts[t + 1]
        docs = self.doc[a:b]
        i, j = np.searchsorted(docs, [lo, hi])
        return docs[i:j], self.impact[a + i : a + j]

    def search(self, item_terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ten best (doc position, score) of one item, by score, then doc_id, with score above 0."""
        bound = weights * self.top[item_terms]
        keep = bound > 0
        item_terms, weights, bound = item_terms[keep], weights[keep], bound[keep]
        order = np.argsort(bound, kind="stable")
        item_terms, weights, bound = item_terms[order], weights[order], bound[order]
        below = np.cumsum(bound)
        best_doc, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(self.doc_ids)
        for lo in range(0, n, WINDOW):
            hi = min(lo + WINDOW, n)
            theta = best_score[-1] if len(best_score) == TOP else 0
            lazy = int(np.searchsorted(below, theta, "right"))  # these lists alone cannot pass theta
            if lazy == len(item_terms):
                break
            score = np.zeros(hi - lo, np.int64)
            seen = np.zeros(hi - lo, bool)
            for t, w in zip(item_terms[lazy:], weights[lazy:]):
                docs, imp = self.postings(t, lo, hi)
                score[docs - lo] += w * imp
                seen[docs - lo] = True
            cand = np.flatnonzero(seen)
            if not len(cand):
                continue
            ceiling = score[cand].copy()
            for t, w in zip(item_terms[:lazy], weights[:lazy]):
                last = self.block_last[t]
                if not len(last):
                    continue
                block = np.minimum(np.searchsorted(last, cand + lo), len(last) - 1)
                ceiling += w * self.block_max[t][block]
            cand = cand[ceiling > theta]
            for t, w in zip(item_terms[:lazy], weights[:lazy]):
                if not len(cand):
                    break
                docs, imp = self.postings(t, lo, hi)
                at = np.searchsorted(docs, cand + lo)
                hit = at < len(docs)
                hit[hit] = docs[at[hit]] == cand[hit] + lo
                score[cand[hit]] += w * imp[at[hit]]
            cand = cand[score[cand] > 0]
            all_doc = np.concatenate([best_doc, cand + lo])
            all_score = np.concatenate([best_score, score[cand]])
            top = np.lexsort((all_doc, -all_score))[:TOP]
            best_doc, best_score = all_doc[top], all_score[top]
        return best_doc, best_score


def corpus_stats(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with at least one term, and L, all their terms."""
    sizes = docs.select(F.size(terms(F.col("text"))).alias("n"))
    row = sizes.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    return int(row["N"]), int(row["L"])


def query_blocks(benchmark: DataFrame) -> list[list[int]]:
    """Item ids in blocks of at most ``QUERY_TERMS`` (item, term) pairs, from counts per item."""
    sizes = benchmark.select("item_id", F.size(F.array_distinct(terms(F.col("text")))).alias("k")).groupBy("item_id").agg(F.sum("k").alias("k"))
    blocks, now, held = [], [], 0
    for row in sizes.orderBy("item_id").toLocalIterator():
        if now and held + row["k"] > QUERY_TERMS:
            blocks.append(now)
            now, held = [], 0
        now.append(row["item_id"])
        held += row["k"]
    return blocks + [now] if now else blocks


def rank_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank int, doc_id, score long): each item's ``TOP`` best documents with score above 0.

    Equal scores go by ascending doc_id; a null doc_id is never returned but counts in the
    statistics; repeated rows are documents of their own. Items without terms, or whose
    terms no document has, have no rows. Other columns of ``docs`` are left.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    benchmark = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull())
    spark = docs.sparkSession
    n_docs, n_terms = corpus_stats(docs)
    heaps = []
    for block in query_blocks(benchmark):
        asked = benchmark.where(F.col("item_id").isin(block)).select("item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
        vocabulary = asked.select("term").distinct()
        df = (docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
              .join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        weights = asked.join(df, "term").select(
            "item_id", "term", F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"))
        rows = weights.collect()  # bounded by QUERY_TERMS
        index = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        items: dict[int, tuple[list[int], list[int]]] = {}
        for r in rows:
            ts, ws = items.setdefault(r["item_id"], ([], []))
            ts.append(index[r["term"]])
            ws.append(r["w"])
        shared = spark.sparkContext.broadcast((
            {t.encode(): i for t, i in index.items()},
            [(i, np.asarray(ts, np.int64), np.asarray(ws, np.int64)) for i, (ts, ws) in sorted(items.items())],
        ))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab, queries = shared.value
            ids, lengths, term_of, doc_of, tf = [], [], [], [], []
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for doc_id, t in zip(batch.column("doc_id").to_pylist(), texts):
                    if doc_id is None:  # counted in the statistics, never returned
                        continue
                    found = _TERM_BYTES.findall(t.encode().translate(_LOWER_BYTES)) if t else []
                    row = len(ids)
                    ids.append(doc_id)
                    lengths.append(len(found))
                    counts: dict[int, int] = {}
                    for w in found:
                        i = vocab.get(w)
                        if i is not None:
                            counts[i] = counts.get(i, 0) + 1
                    term_of.extend(counts)
                    tf.extend(counts.values())
                    doc_of.extend([row] * len(counts))
            shard = Shard(np.asarray(ids, np.int64), np.asarray(term_of, np.int64), np.asarray(doc_of, np.int64),
                          np.asarray(tf, np.int64), np.asarray(lengths, np.int64), n_docs, n_terms, len(vocab))
            out_item, out_doc, out_score = [], [], []
            for item, ts, ws in queries:
                docs_at, scores = shard.search(ts, ws)
                out_item.extend([item] * len(docs_at))
                out_doc.extend(shard.doc_ids[docs_at].tolist())
                out_score.extend(scores.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out_item, pa.int64()), pa.array(out_doc, pa.int64()), pa.array(out_score, pa.int64())],
                                             names=["item_id", "doc_id", "score"])

        heaps.append(spread(docs).mapInArrow(run, "item_id long, doc_id long, score long"))
    if not heaps:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    merged = heaps[0]
    for h in heaps[1:]:
        merged = merged.unionByName(h)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = merged.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= TOP)
    return ranked.select("item_id", "rank", "doc_id", "score")
