"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Features of a text are its tokens (runs of letters and digits, or of other signs, without
white space; case counts) and its pairs of neighbouring tokens, hashed to 2**18 places; all
pairs of a token with itself share one. A feature weighs the square root of its share of the
tokens. The score is a sparse dot product. Only the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscore.llm.common import WordHasher, give_back, mix, slices, spread

PLACES = 1 << 18
#: Labelled rows that the model is fitted on at most: those first by a hash of doc_id.
TRAIN_ROWS = 4096
PASSES = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0, 0.0
THRESHOLD = 0.7


class Features:
    """Sparse features of the texts of a slice."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        letters = np.zeros(256, bool)
        letters[48:58] = letters[65:91] = letters[97:123] = letters[128:] = True
        self.kind = np.where(self.hasher.blank, 0, np.where(letters, 1, 2)).astype(np.uint8)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, value) of each feature, by text and place."""
        hashes, counts = self.hasher.tokens(data, ends, self.kind)
        n = np.diff(counts)
        text = np.repeat(np.arange(len(n)), n)
        same_text = text[1:] == text[:-1]
        pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15))
        pairs[hashes[1:] == hashes[:-1]] = np.uint64(12345)
        place = np.concatenate([hashes, pairs[same_text]]) % np.uint64(PLACES)
        key = np.sort(np.concatenate([text, text[1:][same_text]]).astype(np.int64) * PLACES + place.astype(np.int64))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        text, place = key[first] // PLACES, key[first] % PLACES
        return text, place, np.sqrt(times / n[text])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights (the last is the bias) after following the regularised leader over the rows."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(passes):
        for place, value, label in rows:
            at, x = np.append(place, PLACES), np.append(value, 1.0)
            w = weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(z, n)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept from training: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit on at most ``train_rows`` labelled documents, chosen by a hash of doc_id.

    Rows without label, id or document are left out; of several labels of a document the
    highest counts. Without any row all weights are 0, so each score is one half.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for first, last, data, ends in slices(batch.column("text")):
                text, place, value = features(data, ends)
                cut = np.searchsorted(text, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("label").slice(first, last - first),
                        pa.array([place[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                        pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    ],
                    names=["doc_id", "label", "place", "value"],
                )

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, label int, place binary, value binary")
    # one document of a repeated id, so that the bound holds; the order does not depend on the partitions
    kept = {}
    for r in found.toLocalIterator():  # the least row of an id, kept as they come: one per chosen id
        row = (bytes(r["place"]), bytes(r["value"]), r["label"])
        if r["doc_id"] not in kept or row < kept[r["doc_id"]]:
            kept[r["doc_id"]] = row
    order = np.random.default_rng(42).permutation(len(kept))
    ids = sorted(kept)
    return fit_ftrl(
        [
            (np.frombuffer(p, "<u4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64), label)
            for p, v, label in (kept[ids[i]] for i in order)
        ]
    )


def score_quality(docs: DataFrame, weights: np.ndarray, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1, as ``name``. A null or empty text gets the bias alone."""
    kept = weights.astype(np.float32)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        w = kept.astype(np.float64)
        for batch in batches:
            for first, last, data, ends in slices(batch.column("text")):
                text, place, value = features(data, ends)
                dot = np.bincount(text, w[place] * value, last - first) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*batch.schema.names, name])
        give_back()

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text)."""
    scored = score_quality(spread(docs.select("doc_id", "text")), fit_quality(docs, labels)).drop("text")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
