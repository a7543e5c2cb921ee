"""SentencePiece ids of whole texts by a table of distinct chunks, and their decoding.

The model's pieces never cross a whitespace marker: a space that follows anything but a
space starts a new word. A text is cut there into chunks (a run of spaces, then the rest up
to the next such space; the model's dummy prefix counts as the first chunk's space), each
distinct chunk is segmented once, and a text's ids are its chunks' ids joined back by
position.

The table holds the chunks that are frequent across all texts: a histogram of chunk counts
picks the count from which at most ``TABLE_CHUNKS`` chunks of at most ``TABLE_CHARS``
characters are in it, so that the table has a proven bound and is broadcast. Every other
chunk is segmented where it occurs, once per task and distinct chunk (a worker keeps up to
``CACHE_CHUNKS`` of them). Either way a chunk's ids are the library's for that chunk, so
the result does not depend on what the table holds.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscore.llm.common import spread, store
from litscore.worker import worker_state

#: The table of frequent chunks: at most so many chunks, each of at most so many characters.
#: Its worst case is about 100,000 x (96 bytes of text + 100 ids) = 50 MB; it is broadcast.
TABLE_CHUNKS = 100_000
TABLE_CHARS = 24
#: Chunks outside the table whose ids a worker keeps; beyond that it starts anew.
CACHE_CHUNKS = 200_000
_ROWS = 256
# a space that follows anything but a space begins a chunk
_CUT = re.compile(r"(?<=[^ ])(?= )")
_CUT_JAVA = "(?<=[^ ])(?= )"


class Segmenter:
    """The model without its dummy prefix, so that a chunk's ids are those it has inside a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        proto.normalizer_spec.add_dummy_prefix = False
        if proto.normalizer_spec.remove_extra_whitespaces or not proto.trainer_spec.split_by_whitespace:
            raise ValueError("chunks need a model that keeps spaces and splits words at them")
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.table: dict[str, int] = {}
        self.size = 0  # ids of the table
        self.loaded = None
        self.ids = np.zeros(1 << 16, np.int32)
        self.offsets = np.zeros(1 << 12, np.int64)
        self._clear()

    @classmethod
    def of_worker(cls, path: str) -> Segmenter:
        kept = worker_state()
        key = ("segmenter", path)
        if key not in kept:
            kept[key] = cls(path)
        return kept[key]

    def _clear(self) -> None:
        """Forget the chunks outside the table."""
        self.cache: dict[str, int] = {}
        self.count = len(self.table)  # chunks numbered so far

    def _append(self, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        end = self.offsets[self.count] + np.cumsum(sizes)
        need_ids, need_chunks = int(end[-1]) if len(end) else 0, self.count + len(ids) + 1
        if need_ids > len(self.ids):
            self.ids = np.resize(self.ids, max(need_ids, 2 * len(self.ids)))
        if need_chunks > len(self.offsets):
            self.offsets = np.resize(self.offsets, max(need_chunks, 2 * len(self.offsets)))
        self.ids[self.offsets[self.count] : need_ids] = np.fromiter((x for row in ids for x in row), np.int32, int(sizes.sum()))
        self.offsets[self.count + 1 : need_chunks] = end
        self.count += len(ids)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return _CUT.split(" " + text if self.prefix else text)

    def segment(self, chunks: list[str]) -> list[list[int]]:
        return self.bare.encode(chunks) if chunks else []

    def load(self, chunks: list[str], ids: list[list[int]]) -> None:
        """The broadcast table: chunk -> its ids."""
        self.table = {c: i for i, c in enumerate(chunks)}
        self.count = 0
        self._append(ids)
        self.size = self.count
        self._clear()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the offsets of each text in them."""
        if len(self.cache) > CACHE_CHUNKS:
            self._clear()
        cut = [self.chunks(t) for t in texts]
        table, cache, new = self.table, self.cache, []
        codes = []
        for chunks in cut:
            for c in chunks:
                code = table.get(c)
                if code is None:
                    code = cache.get(c)
                    if code is None:
                        code = cache[c] = self.count + len(new)
                        new.append(c)
                codes.append(code)
        if new:
            self._append(self.segment(new))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.asarray(codes, np.int64)
        lengths = self.offsets[flat + 1] - self.offsets[flat]
        before = np.cumsum(lengths) - lengths
        ids = self.ids[np.repeat(self.offsets[flat] - before, lengths) + np.arange(int(lengths.sum()))]
        per_text = np.zeros(len(cut), np.int64)
        np.add.at(per_text, np.repeat(np.arange(len(cut)), sizes), lengths)
        return ids, np.concatenate([[0], np.cumsum(per_text)])


def chunk_table(docs: DataFrame, path: str, text: str = "text") -> tuple[list[str], list[list[int]]]:
    """The frequent chunks of all texts and their ids; bounded by ``TABLE_CHUNKS`` and ``TABLE_CHARS``.

    Counting is a grouped count with partial aggregation, so a chunk in a third of all texts
    moves once per task. The histogram of counts is at most as long as the number of distinct
    counts; only the chosen chunks reach the driver.
    """
    cut = F.split(F.concat(F.lit(" "), F.col(text)), _CUT_JAVA)
    chunks = docs.where(F.col(text) != "").select(F.explode(cut).alias("chunk"))
    short = chunks.where(F.length("chunk") <= TABLE_CHARS)
    counts = store(short.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "piece_counts")
    histogram = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()
    floor, held = None, 0
    for row in sorted(histogram, key=lambda r: -r["n"]):
        if held + row["k"] > TABLE_CHUNKS:
            break
        floor, held = row["n"], held + row["k"]
    if floor is None:
        return [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Segmenter.of_worker(path)
        for batch in batches:
            words = batch.column("chunk").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(model.segment(words), pa.list_(pa.int32()))], names=["chunk", "ids"])

    rows = counts.where(F.col("n") >= floor).select("chunk").mapInArrow(run, "chunk string, ids array<int>").collect()
    return [r["chunk"] for r in rows], [r["ids"] for r in rows]


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string), one row per row of ``docs``; other columns are left.

    ids are those of the sentencepiece library for the whole text without begin or end ids
    and without sampling; decoded is the library's decode of all of them. A null or empty
    text has no ids and decodes to the empty string; a text of spaces only has ids (the
    model keeps spaces). Repeated rows give repeated results; a null key stays null.
    """
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = docs.sparkSession
    chunks, ids = chunk_table(docs, path)
    shared = spark.sparkContext.broadcast((chunks, ids))
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Segmenter.of_worker(path)
        if model.loaded != token:
            model.load(*shared.value)
            model.loaded = token
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                flat, offsets = model(part.column("text").to_pylist())
                lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
                decoded = [model.whole.decode(flat[offsets[i] : offsets[i + 1]].tolist()) for i in range(len(offsets) - 1)]
                yield pa.RecordBatch.from_arrays([part.column("key"), lists, pa.array(decoded, pa.string())], names=["key", "ids", "decoded"])

    out = spread(docs).mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)


def piece_digest(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of ``encode_pieces``' rows."""
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
