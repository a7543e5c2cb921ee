"""Near-duplicate vectors by binary codes and multi-index Hamming tables.

Iterative quantisation learns rotations of a bounded sample under which the signs of the
coordinates are balanced and close to the vectors. The bits of a vector's code are cut into
substrings, one per table; vectors of one label that agree in a whole substring meet in its
bucket, and are then compared by their original values. The bits are signs of the vectors
themselves, not of their distances from a mean, which would widen the angles of a pair where
vectors share a direction. So at the threshold's angle a pair agrees in a substring of 12
bits with probability 0.22 wherever it lies, in one of 40 with 0.9999, and closer pairs
almost surely. A pair counts in the first table in which it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscore.llm.common import spread, store, whole_groups
from litscore.llm.components import components, forest_of

COSINE = 0.93
TABLES, TABLE_BITS = 40, 12
#: Vectors that rotations are learned from at most, the first by a hash of vec_id.
TRAIN_ROWS = 8192
ROUNDS = 30
#: A bucket of more rows is split into blocks of about half as many, and these are paired.
BUCKET_ROWS = 512


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centre of the unit vectors and a matrix whose columns give one bit each, by ITQ.

    The centre serves the learning alone; a bit is the sign of a vector's own product.
    The mean of a small sample is drawn towards zero, so as not to lie between its vectors.
    """
    dims = sample.shape[1]
    mean = sample.sum(0) / (len(sample) + 1000)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred) if len(sample) else (0, 0, np.eye(dims))
    rng, out = np.random.default_rng([seed, dims]), []
    while sum(o.shape[1] for o in out) < bits:
        turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        projected = centred @ axes.T
        for _ in range(rounds if len(sample) else 0):
            u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        out.append(axes.T @ turn)
    return mean, np.concatenate(out, 1)[:, :bits]


def usable(vector, row_id, label):
    """Whether a row takes part: id, label and vector not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return row_id.isNotNull() & label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision from little-endian doubles."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _links(x: np.ndarray, keys: np.ndarray, table: int, side: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j at or over the threshold that agree in no table before; across sides only, if given."""
    a, b = [], []
    for i in range(0, len(x), 512):
        near = x[i : i + 512] @ x.T >= cosine - 1e-12
        near &= np.arange(len(x)) > np.arange(i, min(i + 512, len(x)))[:, None]
        if side is not None:
            near &= side != side[i : i + 512, None]
        p, q = np.nonzero(near)
        a.append(p + i)
        b.append(q)
    a, b = np.concatenate(a), np.concatenate(b)
    if table:
        first = ~(keys[a, :table] == keys[b, :table]).any(1)
        a, b = a[first], b[first]
    exact = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
    return a[exact], b[exact]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label).

    Rows of equal label are linked when the cosine of their embeddings, in double precision,
    is at least ``cosine``. Null or other unusable vectors, and those of other length, link
    with nothing. Rows of equal vec_id are one vector if all is equal (a repeated row is
    not its own neighbour and gives the same row again), else linked like others. Equal vectors of a label are compared once and counted as often as they occur.
    """
    vec, own = F.col("embedding"), F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", own.alias("embedding"), "label")
    # repeated rows (equal vec_id, label and vector) are one vector; map-side first
    good = rows.filter(usable(vec, F.col("vec_id"), F.col("label"))).dropDuplicates(["vec_id", "label", "embedding"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, "<f8").tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    kind = vectors.schema["label"].dataType.simpleString()
    packed = store(spread(good.select("vec_id", "label", "embedding")).mapInArrow(pack, f"vec_id bigint, label {kind}, raw binary"), "neardup-vectors")
    classes = store(packed.groupBy("label", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "neardup-classes")

    sample: dict[int, list[bytes]] = {}
    for r in classes.select("rep", "raw").orderBy(F.xxhash64("rep"), "rep", "raw").limit(TRAIN_ROWS).collect():
        sample.setdefault(len(r["raw"]), []).append(bytes(r["raw"]))
    bits = TABLES * TABLE_BITS
    learned = {n: learn_rotations(_matrix(pa.array(v)), bits) for n, v in sample.items()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 1 << np.arange(TABLE_BITS)
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("raw").to_pylist()])
            for n in np.unique(sizes):
                part = batch.filter(pa.array(sizes == n))
                _, turns = learned.get(int(n)) or learn_rotations(np.zeros((0, int(n) // 8)), bits)
                signs = _matrix(part.column("raw")) @ turns >= 0
                keys = (signs.reshape(len(part), TABLES, TABLE_BITS) * place).sum(2).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int32()))],
                    names=[*batch.schema.names, "code", "keys"],
                )

    coded = store(
        spread(classes).mapInArrow(encode, f"label {kind}, raw binary, rep bigint, copies bigint, code binary, keys array<int>"), "neardup-codes"
    )
    at = ["label", "size", "table", "key"]
    members = coded.select("rep", "copies", "label", F.length("raw").alias("size"), "raw", "code", F.posexplode("keys").alias("table", "key"))
    crowded = members.groupBy(*at).count().filter(F.col("count") > 1)
    crowded = crowded.select(*at, F.ceil(F.when(F.col("count") > bucket_rows, F.col("count") * 2 / bucket_rows).otherwise(1)).cast("int").alias("blocks"))
    cells = (
        members.join(crowded.hint("merge"), at)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other", "blocks")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(rows: pa.Table) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            rows = rows.combine_chunks()
            x, table = _matrix(rows.column("raw").combine_chunks()), rows.column("table")[0].as_py()
            keys = np.frombuffer(b"".join(rows.column("code").to_pylist()), "<u2").reshape(len(rows), TABLES)
            low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
            side = rows.column("block").to_numpy() if low != high else None
            a, b = _links(x, keys, table, side, cosine)
            if not len(a):
                return None
            reps, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
            order = np.argsort(reps, kind="stable")
            rank = np.empty(len(reps), np.int64)
            rank[order] = np.arange(len(reps))
            head = reps[order][forest_of(len(reps), rank[a], rank[b])][rank]
            links = np.bincount(a, copies[b], len(reps)) + np.bincount(b, copies[a], len(reps))
            some = np.flatnonzero(links > 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(reps[some]), pa.array(head[some]), pa.array(links[some].astype(np.int64))], names=["rep", "head", "links"]
            )

        for rows in whole_groups(batches, names):
            if (out := cell(rows)) is not None:
                yield out

    names = [*at, "low", "high"]
    spread_cells = cells.repartition(*names).sortWithinPartitions(*names)
    found = store(spread_cells.mapInArrow(compare, "rep bigint, head bigint, links bigint"), "neardup-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    copies = packed.join(classes.withColumnsRenamed({"label": "l", "raw": "r"}).filter("copies > 1").hint("merge"), (F.col("label") == F.col("l")) & (F.col("raw") == F.col("r")))
    component = components(
        found.select(F.col("rep").alias("a"), F.col("head").alias("b")).union(copies.select("vec_id", "rep")), "neardup-components"
    )
    counted = (
        packed.join(classes.withColumnsRenamed({"label": "l", "raw": "r"}).hint("merge"), (F.col("label") == F.col("l")) & (F.col("raw") == F.col("r")))
        .select("vec_id", "rep", "copies")
        .join(linked.hint("merge"), "rep", "left")
        .groupBy("vec_id")
        .agg(F.max(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    result = (
        vectors.select("vec_id")
        .join(counted.hint("merge"), "vec_id", "left")
        .join(component.withColumnRenamed("node", "vec_id").hint("merge"), "vec_id", "left")
    )
    group = F.coalesce("component", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), group.alias("component_id"),
        F.coalesce(group == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
