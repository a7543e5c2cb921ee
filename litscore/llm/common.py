"""Helpers of the training-data operators: stored tables, texts as numpy arrays, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import litscore
from litscore.session import scratch_path

# Functions of this package travel with the tasks; workers need not have it installed.
cloudpickle.register_pickle_by_value(litscore)

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Texts are worked on in slices of about this many bytes, so that arrays stay small.
SLICE_BYTES = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows in an Arrow batch: texts are long, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have batches of ``BATCH_ROWS`` rows, unless the session has set a number of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def give_back() -> None:
    """Return what a worker has freed to the system, so that idle workers stay small."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only the GNU library has it
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back.

    Survives lost executors; the shuffle files of the write are given up when it ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path, schema = scratch_path(spark, name), df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """Spread a table stored as fewer pieces than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``SLICE_BYTES``.

    Yields (first row, end row, UTF-8 bytes, offsets of the texts in them); null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash."""
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class WordHasher:
    """Hashes of the words of texts: maximal runs of bytes other than space and 9 to 13.

    A word's hash is a polynomial over random values of its bytes, so all words of a
    slice are hashed by whole-array operations. ``lower`` folds A-Z.
    """

    def __init__(self, lower: bool = False) -> None:
        values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        values[self.blank] = 0
        if lower:
            values[65:91] = values[97:123]
        self.values = values
        self.powers = _powers(1 << 10)

    def _sums(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers[0]) < n:
            self.powers = _powers(max(n, SLICE_BYTES))
        if not len(starts):
            return np.zeros(0, np.uint64)
        return mix(np.add.reduceat(self.values[data] * self.powers[0][:n], starts) * self.powers[1][starts])

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and the number of words before each text (and in all)."""
        return self.tokens(data, ends, ~self.blank)

    def tokens(self, data: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of bytes of one kind; kind 0 separates them."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
        kind = kinds[data]
        begins = kind != 0
        begins[1:] &= kind[1:] != kind[:-1]
        first = ends[:-1][ends[:-1] < len(data)]
        begins[first] = kind[first] != 0
        starts = np.flatnonzero(begins)
        return self._sums(data, starts), np.searchsorted(starts, ends)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, from batches sorted so that groups are contiguous."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        change = np.zeros(max(len(now) - 1, 0), bool)
        for n in names:
            c = now.column(n).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for i, j in zip(cuts, cuts[1:]):
            yield now.slice(i, j - i)
        held = now.slice(cuts[-1])
    if held is not None and len(held):
        yield held
