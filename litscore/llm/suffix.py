"""Remove repeated passages of texts, by refining buckets of their suffixes.

A byte goes if a string of LENGTH bytes over it also starts in a document of smaller id.

The suffixes that can matter are found first. Each window of LENGTH bytes has a key, the
least hash of its GRAM-byte grams; neighbouring windows of one key form a segment. Equal
windows have equal keys, so only segments whose key occurs in several documents are kept, once
per content and bucket of documents. All suffixes of the segments of a key are then sorted by
bucket-pointer refinement: the first 8 bytes make buckets, the bucket numbers at the offset
already compared are the sort keys of the next refinement, and the new numbers are reused at
once, so that 8, 16, 32 and LENGTH bytes take four sorts. The suffixes of a final bucket
start with the same LENGTH bytes; the smallest id among their documents is sent back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscore.llm.common import _powers, give_back, mix, slices, store
from litscore.llm.shared import among, bucket_of, bucketed, merged, narrow, shared_hashes

LENGTH, GRAM = 50, 18
#: Windows in a segment at most, so that periodic texts do not make long segments.
SEGMENT = 64
#: Segments whose suffixes are sorted together, about; keys are never divided.
SORTED_ROWS = 40_000
_NONE = np.iinfo(np.int64).max


class Segments:
    """Cuts texts into segments: runs of windows of one key within a document."""

    def __init__(self) -> None:
        rng = np.random.default_rng(977)
        self.values = rng.integers(1, 1 << 63, 256, np.uint64)
        self.factors = rng.integers(1, 1 << 62, 3, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = _powers(1 << 10)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first byte in the slice, windows, key) of each segment."""
        n = len(data) - LENGTH + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64)
        raw = np.ascontiguousarray(data)
        eight = np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))
        grams = len(raw) - GRAM + 1
        a, b, c = self.factors
        key = eight[:grams] * a
        key ^= key >> np.uint64(32)
        key += eight[8 : 8 + grams]
        key *= b
        key ^= key >> np.uint64(29)
        key += eight[10 : 10 + grams]
        key *= c
        key ^= key >> np.uint64(31)
        span = LENGTH - GRAM + 1  # grams in a window
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        key = key[:n]
        lengths = np.diff(ends)
        windows = np.maximum(lengths - LENGTH + 1, 0)
        cut = np.ones(n, bool)
        cut[1:] = key[1:] != key[:-1]
        starts = ends[:-1][windows > 0]
        cut[starts] = True
        stops = (ends[:-1] + windows)[windows > 0]
        cut[stops[stops < n]] = True
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, n))
        text = np.searchsorted(ends, first, "right") - 1
        inside = first < (ends[:-1] + windows)[text]
        first, size, text = first[inside], size[inside], text[inside]
        more = -(-size // SEGMENT)
        if (more > 1).any():
            number = np.arange(int(more.sum())) - np.repeat(more.cumsum() - more, more)
            left = np.repeat(size, more) - number * SEGMENT
            first, text = np.repeat(first, more) + number * SEGMENT, np.repeat(text, more)
            size = np.minimum(left, SEGMENT)
        return text, first, size, key[first]

    def contents(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each segment."""
        n = len(data)
        if len(self.powers[0]) < n:
            self.powers = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[0][:n], out=total[1:])
        last = first + size + LENGTH - 1
        return mix((total[last] - total[first]) * self.powers[1][first] + size.astype(np.uint64))


def _keys() -> object:
    own = Segments()

    def parts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, _, _, key = own(data, ends)
        return text, key

    return parts


def refine(texts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of the suffixes of strings of at least ``length`` bytes.

    Returns the positions at which a string has ``length`` bytes left and the number of the
    final bucket of each; equal numbers mean equal bytes.
    """
    sizes = np.diff(ends)

    def places(depth: int) -> np.ndarray:
        own = sizes - depth + 1
        return np.repeat(ends[:-1] - (own.cumsum() - own), own) + np.arange(int(own.sum()))

    depth = 8
    at = places(depth)
    raw = np.ascontiguousarray(texts)
    first = np.ndarray(len(raw) - 7, ">u8", raw.data, strides=(1,))[at].astype(np.uint64)
    pointer = np.zeros(len(texts), np.int64)
    pointer[at] = np.unique(first, return_inverse=True)[1]
    while depth < length:
        reach = min(2 * depth, length)
        at = places(reach)
        own, later = pointer[at], pointer[at + reach - depth]
        crowd = np.bincount(own)[own] > 1  # buckets of one need no more sorting
        key = own * np.int64(len(texts) + 1) + np.where(crowd, later, 0)
        updated = np.zeros(len(texts), np.int64)
        updated[at] = np.unique(key, return_inverse=True)[1]
        pointer, depth = updated, reach
    return at, pointer[at]


def repeated_spans(docs: DataFrame) -> tuple[int, DataFrame]:
    """The number of buckets, and for each bucket and segment content the smallest ids of its windows.

    The table has bucket, content, and ``counts`` windows in a row that start in the
    document ``lows`` first.
    """
    dealt, n = bucketed(docs)
    shared = shared_hashes(dealt, n, _keys, "suffix-keys")

    def collect(texts: pa.Table, hashes: pa.Table) -> pa.Table:
        own, known, out = Segments(), merged(hashes), []
        ids = texts.column("doc_id").combine_chunks()
        bucket = texts.column("bucket")[0].as_py() if len(texts) else 0
        for first_row, last_row, data, ends in slices(texts.column("text")) if len(known) else ():
            text, first, size, key = own(data, ends)
            doc = ids.slice(first_row, last_row - first_row)
            valid = np.array(doc.is_valid())
            doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
            kept = among(narrow(key, n), known) & valid[text]
            text, first, size, key = text[kept], first[kept], size[kept], key[kept]
            content, doc = own.contents(data, first, size), doc[text]
            order = np.lexsort((doc, content))
            content, doc = content[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]])) if len(content) else np.zeros(0, np.int64)
            if not len(new):
                continue
            top = np.append(new[1:], len(content)) - 1
            at, raw = order[new], data.tobytes()
            strings = [raw[a:b] for a, b in zip(first[at].tolist(), (first[at] + size[at] + LENGTH - 1).tolist())]
            out.append(pa.table({"bucket": pa.array([bucket] * len(at), pa.int32()), "key": key[at].view(np.int64), "content": content[new].view(np.int64), "low": doc[new], "high": doc[top], "string": pa.array(strings, pa.binary())}))
        give_back()
        if not out:
            return pa.table({"bucket": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "content": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64()), "string": pa.array([], pa.binary())})
        every = pa.concat_tables(out)
        if len(out) == 1:
            return every
        ends = every.group_by(["bucket", "key", "content"]).aggregate([("low", "min"), ("high", "max"), ("string", "min")])
        return ends.select(["bucket", "key", "content", "low_min", "high_max", "string_min"]).rename_columns(every.column_names)

    segments = dealt.groupBy("bucket").cogroup(shared.groupBy("origin")).applyInArrow(
        collect, "bucket int, key bigint, content bigint, low bigint, high bigint, string binary"
    )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            if len(held) >= SORTED_ROWS:
                keys = held.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield from lowest(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and len(held):
            yield from lowest(held)
        give_back()

    def lowest(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, content = rows.column("key").to_numpy(), rows.column("content").to_numpy()
        low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
        order = np.lexsort((content, key))
        head = np.ones(len(order), bool)
        head[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = head.cumsum() - 1
        first = order[head]  # one row of each distinct segment
        least = np.full(len(first), _NONE)
        np.minimum.at(least, which, low)
        strings = rows.column("string").take(pa.array(first)).combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        data = np.frombuffer(strings.buffers()[2], np.uint8)
        windows = np.diff(ends) - LENGTH + 1
        value = np.repeat(least, windows)  # of each window
        # keys of a single content need no sorting: its windows occur in no other
        own_key = key[first]
        many = np.zeros(len(first), bool)
        many[1:] |= own_key[1:] == own_key[:-1]
        many[:-1] |= own_key[1:] == own_key[:-1]
        if many.any():
            some = np.flatnonzero(many)
            lengths = np.diff(ends)[some]
            own_ends = np.concatenate([[0], lengths.cumsum()])
            take = np.repeat(ends[:-1][some] - own_ends[:-1], lengths) + np.arange(own_ends[-1])
            _, bucket = refine(data[take], own_ends)
            at = np.repeat(many, windows)
            smallest = np.full(int(bucket.max()) + 1, _NONE)
            np.minimum.at(smallest, bucket, value[at])
            value[at] = smallest[bucket]
        start = np.concatenate([[0], windows.cumsum()])
        overall = np.minimum.reduceat(value, start[:-1])
        use = np.flatnonzero(overall[which] < high)
        if not len(use):
            return
        change = np.ones(len(value), bool)
        change[1:] = value[1:] != value[:-1]
        change[start[:-1]] = True
        runs = np.flatnonzero(change)
        counts, lows = np.diff(np.append(runs, len(value))), value[runs]
        edge = np.searchsorted(runs, start)
        mine = which[use]
        sizes = edge[mine + 1] - edge[mine]
        take = np.repeat(edge[mine] - (sizes.cumsum() - sizes), sizes) + np.arange(int(sizes.sum()))
        offsets = pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32())
        out = pa.table(
            {
                "bucket": rows.column("bucket").take(pa.array(use)).combine_chunks(),
                "content": content[use],
                "counts": pa.ListArray.from_arrays(offsets, pa.array(counts[take].astype(np.int32))),
                "lows": pa.ListArray.from_arrays(offsets, pa.array(lows[take])),
            }
        )
        yield from out.to_batches()

    spans = segments.repartition("key").sortWithinPartitions("key").mapInArrow(
        sort, "bucket int, content bigint, counts array<int>, lows array<bigint>"
    )
    return n, store(spans, "suffix-spans")


def _removed(own: Segments, data: np.ndarray, ends: np.ndarray, doc: np.ndarray, known: tuple) -> np.ndarray:
    """Whether each byte of a slice is covered by a window that starts in a document of smaller id."""
    content, edge, counts, lows = known
    text, first, size, _ = own(data, ends)
    hashes = own.contents(data, first, size).view(np.int64)
    place = np.minimum(np.searchsorted(content, hashes), len(content) - 1)
    hit = content[place] == hashes
    text, first, place = text[hit], first[hit], place[hit]
    runs = edge[place + 1] - edge[place]
    which = np.repeat(np.arange(len(place)), runs)
    take = np.repeat(edge[place] - (runs.cumsum() - runs), runs) + np.arange(int(runs.sum()))
    count = counts[take]
    before = count.cumsum() - count
    begin = first[which] + before - np.repeat(before[runs.cumsum() - runs] if len(runs) else before[:0], runs)
    gone = lows[take] < doc[text[which]]
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, begin[gone], 1)
    np.add.at(step, begin[gone] + count[gone] + LENGTH - 1, -1)
    return step.cumsum()[:-1] > 0


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried, n_bytes, n_removed, n_spans, kept), one row per row of ``docs`` (doc_id, text).

    ``kept`` holds the UTF-8 bytes that stay, ``carried`` the columns named by ``carry``. A null or empty text has no bytes, one of fewer
    than LENGTH loses none. Rows of equal doc_id do not remove each other's bytes; rows
    without doc_id neither lose nor remove any. Other columns are ignored.
    """
    n, spans = repeated_spans(docs)
    carried = F.struct(F.col("text").isNull().alias("no_text"), *carry).alias("carried")
    dealt = docs.select(bucket_of(n), "doc_id", "text", carried)
    schema = dealt.select("doc_id", "carried").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        schema = schema.add(name, kind)

    def apply(texts: pa.Table, found: pa.Table) -> pa.Table:
        own, columns = Segments(), {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
        ids = texts.column("doc_id").combine_chunks()
        order = np.argsort(found.column("content").to_numpy(), kind="stable")
        found = found.take(pa.array(order)).combine_chunks()
        content = found.column("content").to_numpy()
        new = np.ones(len(content), bool)
        new[1:] = content[1:] != content[:-1]
        found = found.filter(pa.array(new)).combine_chunks()
        known = None
        if len(found):
            counts = found.column("counts").combine_chunks()
            sizes = np.array(counts.value_lengths(), np.int64)
            lows = found.column("lows").combine_chunks()
            known = (content[new], np.concatenate([[0], sizes.cumsum()]), counts.flatten().to_numpy().astype(np.int64), lows.flatten().to_numpy())
        for first_row, last_row, data, ends in slices(texts.column("text")):
            part = ids.slice(first_row, last_row - first_row)
            doc = part.fill_null(-_NONE).to_numpy(zero_copy_only=False)
            gone = _removed(own, data, ends, doc, known) if known else np.zeros(len(data), bool)
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = ends[:-1][ends[:-1] < len(data)]
            edge[inner] = gone[inner]
            removed, spans = (np.concatenate([[0], x.cumsum()]) for x in (gone, edge))
            columns["n_bytes"].append(np.diff(ends))
            columns["n_removed"].append(np.diff(removed[ends]))
            columns["n_spans"].append(np.diff(spans[ends]))
            raw = data[~gone].tobytes()
            at = (ends - removed[ends]).tolist()
            columns["kept"] += [raw[a:b] for a, b in zip(at, at[1:])]
        give_back()
        number = lambda k: pa.array(np.concatenate(columns[k]) if columns[k] else [], pa.int64())
        return pa.table([ids, texts.column("carried"), number("n_bytes"), number("n_removed"), number("n_spans"), pa.array(columns["kept"], pa.binary())], names=["doc_id", "carried", "n_bytes", "n_removed", "n_spans", "kept"])

    return dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(apply, schema)


def digest(removed: DataFrame) -> DataFrame:
    """``kept`` replaced by its sha256 in lower-case hexadecimal."""
    return removed.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept", "carried")
