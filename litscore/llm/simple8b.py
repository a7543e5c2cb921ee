"""Token ids in a binary table: Simple-8b words in blocks of whole documents.

A word of 64 bits has a selector in its upper 4 bits, which says how many ids of how many
bits the lower 60 hold (first id lowest). Selector 0 is the escape: the next word is one id
of up to 64 bits. Words never cross the runs of ``RUN`` ids into which a block is cut, and
each run's first word is listed, so that any run is decoded alone and all at once.

A file row is a block: part and block number, ids of the part before it, doc_ids and their
id counts in order, words (little-endian), and the first word of each run. Parts and blocks
in ascending order hold the documents in ascending doc_id order. Spark's own Parquet writer
stores the rows, so a dataset lies wherever Spark can write.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litscore.llm.common import slices
from litscore.llm.tokens import CachedTokenizer

#: Fixed values of the format: ids in a word and bits of each, for selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 0
RUN = 1024
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16
SCHEMA = (
    "part int, block int, first bigint, doc_ids array<bigint>, counts array<bigint>,"
    " words binary, run_words array<int>"
)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words for the ids, and the first word of each run of ``RUN`` ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    high = np.frexp(ids.astype(np.float64))[1]
    # a large integer may round up to the next power of two; then its own bits decide
    exact = np.where((high > 1) & (ids < (np.uint64(1) << np.clip(high - 1, 0, 63).astype(np.uint64))), high - 1, high)
    bits = np.minimum(exact, 64).astype(np.uint8)
    longest = {1: bits}
    for k in (1, 2, 4, 8, 16):
        m = longest[k]
        longest[2 * k] = np.maximum(m[:-k], m[k:]) if len(m) > k else m[:0]
    step = np.where(bits > 60, 0, 1).astype(np.uint8)
    left = RUN - np.arange(n) % RUN
    left = np.minimum(left, n - np.arange(n))
    for count, width in sorted(zip(COUNTS, BITS))[1:]:
        k = 1 << (count.bit_length() - 1)
        m = longest[k]
        if len(m) <= count - k:
            continue
        if count > k:
            m = np.maximum(m[: len(m) - (count - k)], m[count - k :])
        fits = (m <= width) & (left[: len(m)] >= count)
        step[: len(m)][fits] = count
    steps, at, i = step.tobytes(), [], 0
    while i < n:
        at.append(i)
        i += steps[i] or 1
    at = np.array(at)
    taken = step[at]
    width = np.where(taken == 0, 2, 1)
    place = width.cumsum() - width
    words = np.zeros(int(width.sum()), np.uint64)
    for selector, (count, bit) in enumerate(zip(COUNTS, BITS), 1):
        own = np.flatnonzero(taken == count)
        if len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bit)
            packed = np.bitwise_or.reduce(ids[at[own][:, None] + np.arange(count)] << shifts, axis=1)
            words[place[own]] = packed | np.uint64(selector << 60)
    own = np.flatnonzero(taken == 0)
    words[place[own] + 1] = ids[at[own]]
    return words, place[np.searchsorted(at, np.arange(0, n, RUN))].astype(np.int32)


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole runs of words."""
    words = np.ascontiguousarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selectors == ESCAPE):  # a raw word may look like anything, an escape too
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    escapes = (selectors == ESCAPE) & ~raw
    counts = np.array((0, *COUNTS, 0))[selectors]
    counts[escapes], counts[raw] = 0, 1
    ends = counts.cumsum()
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector, (count, bit) in enumerate(zip(COUNTS, BITS), 1):
        own = np.flatnonzero((selectors == selector) & ~raw)
        if len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bit)
            mask = np.uint64((1 << bit) - 1)
            out[(ends[own] - count)[:, None] + np.arange(count)] = (words[own][:, None] >> shifts) & mask
    out[ends[raw] - 1] = words[raw]
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode whole texts and write their ids below ``path`` in ascending doc_id order.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text is the end
    id alone. A null doc_id comes first; rows of equal doc_id follow each other by text. An
    empty table gives an empty dataset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CachedTokenizer.of_worker(tokenizer, drop_space=True, special=True)
        part = TaskContext.get().partitionId()
        block, first, size_now, held, doc_ids, counts = 0, 0, 0, [], [], []

        def full() -> pa.RecordBatch:
            words, runs = encode(np.concatenate(held))
            row = {
                "part": [part], "block": [block], "first": [first], "doc_ids": [doc_ids], "counts": [counts],
                "words": [words.astype("<u8").tobytes()], "run_words": [runs.tolist()],
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            for start, stop, data, ends in slices(batch.column("text")):
                rows = batch.slice(start, stop - start)
                ids, sizes = own.encode(data, ends)
                done = 0
                for doc_id, size in zip(rows.column("doc_id").to_pylist(), sizes.tolist()):
                    held += [ids[done : done + size], np.array([end_id], np.uint32)]
                    done += size
                    doc_ids.append(doc_id)
                    counts.append(size + 1)
                    size_now += size + 1
                    if size_now >= BLOCK_IDS or len(counts) >= 4096:
                        yield full()
                        block, first, size_now = block + 1, first + size_now, 0
                        held, doc_ids, counts = [], [], []
        if counts:
            yield full()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of a dataset, ids as little-endian 32-bit integers."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum(F.expr("aggregate(counts, 0L, (a, b) -> a + b)")).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], "<u8")).astype("<u4").tobytes()
                counts = np.array(row["counts"], np.int64)
                starts = counts.cumsum() - counts
                cut = [ids[4 * a : 4 * (a + n)] for a, n in zip(starts.tolist(), row["counts"])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["first"] + before[row["part"]], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(cut, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def crc(ids: DataFrame) -> DataFrame:
    """``ids`` column replaced by its unsigned crc32, as ``ids_crc32``."""
    return ids.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


