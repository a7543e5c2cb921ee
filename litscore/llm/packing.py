"""Pack documents into sequences of a fixed length by best-fit decreasing.

A document longer than a window is first cut into full windows; its rest, like a short
document, is placed whole. Rests are taken from the longest to the shortest, each into the
open window whose free space it fills best. A segment tree over the free capacities 0 to the
window length finds that window in a few steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscore.llm.common import give_back, slices, spread, store
from litscore.llm.tokens import CachedTokenizer

WINDOW = 1024
#: Documents packed together, on average; windows are not shared between groups.
GROUP_DOCS = 2048
END_ID = 0


class OpenWindows:
    """Open windows by free capacity, with the smallest sufficient capacity found in a tree."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += by
            node >>= 1

    def push(self, capacity: int, window_no: int) -> None:
        self.stacks[capacity].append(window_no)
        self._add(capacity, 1)

    def pop(self, size: int) -> tuple[int, int] | None:
        """Take out the window with the least free capacity of at least ``size``."""
        node = size + self.leaves
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node <<= 1
                if not self.open[node]:
                    node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each size (0 < size <= window), and the number of windows."""
    tree, n = OpenWindows(window), 0
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        found = tree.pop(size)
        if found is None:
            found, n = (window, n), n + 1
        capacity, at = found
        number[i], offset[i] = at, window - capacity
        if capacity > size:
            tree.push(capacity - size, at)
    return number, offset, n


def token_counts(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, doc_tokens, crcs): tokens with the end id, and the crc32 of each window of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = CachedTokenizer.of_worker(path, special=True)
        for batch in batches:
            for first, last, data, ends in slices(batch.column("text")):
                part = batch.slice(first, last - first)
                ids, counts = tokenizer.encode(data, ends)
                ids = np.insert(ids.astype("<u4"), counts.cumsum(), end_id)
                counts = counts + 1
                raw, starts = memoryview(ids.tobytes()), np.concatenate([[0], counts.cumsum()])
                crcs = [
                    [zlib.crc32(raw[4 * i : 4 * min(i + window, b)]) for i in range(a, b, window)]
                    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                    names=["doc_id", "doc_tokens", "crcs"],
                )
        give_back()

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, doc_tokens bigint, crcs array<bigint>")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text is the end
    id alone. Rows of equal (or null) doc_id are documents of their own. An empty table gives
    no rows. Documents are dealt by a hash to groups of about ``group_docs``; each group is
    packed alone, so no task holds more than one, and sequence_id is the group's number in
    its high 31 bits and the window's number in the group.
    """
    counted = store(token_counts(docs, path, window, end_id), "pack-tokens")
    groups = max(1, -(-counted.count() // group_docs))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens"], kind="stable")
        tokens = rows["doc_tokens"].to_numpy(np.int64)
        full, rest = tokens // window, tokens % window
        pieces = full + (rest > 0)
        which = np.repeat(np.arange(len(rows)), pieces)
        order = np.arange(len(which)) - np.repeat(pieces.cumsum() - pieces, pieces)
        is_rest = order == full[which]
        number, offset, n = best_fit_decreasing(rest[rest > 0], window)
        sequence, offsets = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        sequence[is_rest], offsets[is_rest] = number, offset
        sequence[~is_rest] = n + np.arange(int((~is_rest).sum()))
        crcs = np.concatenate(rows["crcs"].to_list()) if len(rows) else np.zeros(0, np.int64)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].to_numpy()[which],
                "start": order * window,
                "length": np.where(is_rest, rest[which], window),
                "ids_crc32": crcs.astype(np.int64),
                "doc_tokens": tokens[which],
                "sequence_id": (int(key[0]) << 32) + sequence,
                "offset": offsets,
            }
        ).astype({"doc_id": "Int64"})

    keyed = counted.withColumn("group", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(groups)))
    return keyed.groupBy("group").applyInPandas(
        place,
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
