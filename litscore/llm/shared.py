"""Which hashes of a document's parts occur in other documents too.

Documents are dealt to buckets by their id. A bucket sends the distinct hashes of its
documents to key buckets, as compact arrays; a key bucket finds those of more than one
document and sends them back. So every task handles one bucket, whatever is common in the
corpus is sent once per bucket, and no table of all hashes exists.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litscore.llm.common import give_back, slices, store

#: Documents in a bucket, on average.
BUCKET_DOCS = 2048
BLOB = "at int, origin int, n int, data binary"
#: (bytes, ends) -> (number of the text, hash) of the parts of the texts of a slice.
Parts = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, doc_id, text) and the number of buckets."""
    n = max(1, -(-docs.count() // BUCKET_DOCS))
    return docs.select(bucket_of(n), "doc_id", "text"), n


def bucket_of(n: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket")


def narrow(hashes: np.ndarray, keys: int) -> np.ndarray:
    """Key bucket in the upper, 32 more bits of the hash in the lower half.

    Hashes that agree in these only pass for shared; what follows compares in full.
    """
    k = np.uint64(keys)
    return ((hashes % k) << np.uint64(32)) | ((hashes // k) & np.uint64(0xFFFFFFFF))


def put(values: np.ndarray) -> bytes:
    """Ascending 32-bit integers as differences, byte by byte, for the shuffle's compression."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def get(data: bytes, n: int) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T).view("<u4")
    return np.cumsum(steps.ravel(), dtype=np.uint32)


def _blobs(at: list, origin: list, n: list, data: list) -> pa.Table:
    return pa.table(
        [pa.array(at, pa.int32()), pa.array(origin, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())],
        names=["at", "origin", "n", "data"],
    )


def shared_hashes(docs: DataFrame, buckets: int, parts: Callable[[], Parts], name: str, counted: bool = False) -> DataFrame:
    """For each bucket (``origin``) the narrowed hashes of its parts that another document has too, by key bucket (``at``).

    With ``counted`` each has a byte that tells how many documents hold it, see :func:`merged`.
    """

    def send(table: pa.Table) -> pa.Table:
        own, per_doc, origin = parts(), [], table.column("bucket")[0].as_py()
        for _, _, data, ends in slices(table.column("text")):
            text, hashes = own(data, ends)
            key = narrow(hashes, buckets)
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            per_doc.append(key[new])
        keys, times = np.unique(np.concatenate(per_doc), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        at = np.flatnonzero(np.diff(cuts))
        note = (lambda n: np.minimum(n, 255).astype(np.uint8)) if counted else (lambda n: np.packbits(n > 1))
        data = [
            put(keys[a:b] & np.uint64(0xFFFFFFFF)) + note(times[a:b]).tobytes() for a, b in zip(cuts[at], cuts[at + 1])
        ]
        give_back()
        return _blobs(at.tolist(), [origin] * len(at), np.diff(cuts)[at].tolist(), data)

    def weigh(table: pa.Table) -> pa.Table:
        at, origins, sizes = table.column("at")[0].as_py(), table.column("origin").to_pylist(), table.column("n").to_pylist()
        blobs = table.column("data").to_pylist()
        keys = np.concatenate([get(d, n) for d, n in zip(blobs, sizes)])
        times = np.concatenate([np.frombuffer(d, np.uint8, offset=4 * n) for d, n in zip(blobs, sizes)])
        order = np.argsort(keys, kind="stable")
        new = np.diff(keys[order], prepend=~keys[order[:1]]) != 0
        sums = np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(new))
        held = np.empty(len(keys), np.int64)
        held[order] = sums[np.cumsum(new) - 1]
        degree = np.frexp(held)[1].astype(np.uint8)
        ends = np.cumsum(sizes)
        out = [(k, keys[a:b][more], degree[a:b][more]) for k, a, b in zip(origins, ends - sizes, ends) if (more := held[a:b] > 1).any()]
        return _blobs([at] * len(out), [k for k, _, _ in out], [len(k) for _, k, _ in out], [put(k) + d.tobytes() for _, k, d in out])

    def find(table: pa.Table) -> pa.Table:
        at, origins, sizes = table.column("at")[0].as_py(), table.column("origin").to_pylist(), table.column("n").to_pylist()
        own = [(get(d, n), np.unpackbits(np.frombuffer(d, np.uint8, offset=4 * n), count=n) > 0) for d, n in zip(table.column("data").to_pylist(), sizes)]
        every = np.sort(np.concatenate([k for k, _ in own]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for k, several in own:
            place = np.minimum(np.searchsorted(twice, k), max(len(twice) - 1, 0))
            out.append(k[several | (twice[place] == k)] if len(twice) else k[several])
        kept = [i for i, k in enumerate(out) if len(k)]
        return _blobs([at] * len(kept), [origins[i] for i in kept], [len(out[i]) for i in kept], [put(out[i]) for i in kept])

    sent = docs.groupBy("bucket").applyInArrow(send, BLOB)
    return store(sent.groupBy("at").applyInArrow(weigh if counted else find, BLOB), name)


def _by_key(table: pa.Table) -> list[tuple[int, int, bytes]]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("at", "n", "data"))), key=lambda r: r[0])


def merged(table: pa.Table) -> np.ndarray:
    """The narrowed shared hashes of a bucket, ascending."""
    return np.concatenate([np.zeros(0, np.uint64), *((np.uint64(at) << np.uint64(32)) | get(d, n).astype(np.uint64) for at, n, d in _by_key(table))])


def degrees(table: pa.Table) -> np.ndarray:
    """Of each of :func:`merged`, if counted, the binary digits of the number of documents that hold it.

    Every bucket is told the same of a hash.
    """
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(d, np.uint8, offset=4 * n) for _, n, d in _by_key(table))])


def positions(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Where each value is among ``ascending``; -1 if it is not."""
    if not len(ascending):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return np.where(ascending[at] == values, at, -1)


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    return positions(values, ascending) >= 0
