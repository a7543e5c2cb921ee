"""Nearest neighbours by collision counting over single projections.

Each block of vectors keeps, for each of many random projections, its values in order. Around
a query's value a window is opened in every projection and widened step by step (virtual
rehashing), and each vector counts in how many windows it lies. One that reaches the
threshold is verified with its original values. A vector at distance d lies in a window of
half-width w with the probability that a normal variable of deviation d is within w; the
threshold is two deviations below what that gives for d = w / REACH, so once the k-th best
verified distance is no more than w / REACH, nearer vectors have been verified with
probability 0.97, and the search of the block ends.

Blocks hold vectors of one direction. A query first searches the block it lies in. The k-th
best distance found there goes with it to the other blocks: one that cannot hold a vector as
near, by the angles between the query, the block's pivot and the block's vectors, is not
visited, and in the others the windows are opened once, as wide as that distance asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscore.llm.common import spread, store

NEIGHBOURS = 5
PROJECTIONS = 128
# Rows of a block, and queries that meet it at once.
BLOCK_ROWS, GROUP_QUERIES = 8192, 4096
# Directions that the vectors of one length are dealt to, at most; a crowded one has several blocks.
MAX_CELLS = 1024
FIRST_WIDTH, WIDEN = 0.25, 1.22
REACH = 0.9
# Windows of this half-width hold everything.
_ALL = 4 * sqrt(2)
# By length: the cells that hold vectors, each with its blocks, its widest and its least angle.
Directions = dict[int, list[tuple[int, int, float, float]]]
# Vectors whose collisions are counted at once, so that their ranks stay in a core's cache.
_STRIP_ROWS = 2048


def threshold(projections: int = PROJECTIONS) -> int:
    """Collisions at which a vector is verified."""
    p = erf(REACH / sqrt(2))
    return int(projections * p - 2 * sqrt(projections * p * (1 - p)))


class Projections:
    """The sorted projections of a block of unit vectors, and the rank of each vector in them."""

    def __init__(self, vectors: np.ndarray, seed: int = 11) -> None:
        n, dims = vectors.shape
        rng, lines = np.random.default_rng([seed, dims]), []
        for _ in range(-(-PROJECTIONS // dims)):
            lines.append(np.linalg.qr(rng.standard_normal((dims, dims)))[0] * sqrt(dims))
        self.vectors, self.lines = vectors, np.concatenate(lines, 1)[:, :PROJECTIONS]
        values = vectors @ self.lines
        order = np.argsort(values, axis=0, kind="stable").T
        # one sorted array for all projections: each lies in a stretch of its own
        self.shift = np.arange(PROJECTIONS) * (4 * sqrt(dims) + 4 * _ALL)
        self.values = (np.sort(values, axis=0).T + self.shift[:, None]).ravel()
        ranks = np.empty((PROJECTIONS, n), np.min_scalar_type(n))
        np.put_along_axis(ranks, order, np.arange(n, dtype=ranks.dtype)[None, :], axis=1)
        strips = range(0, n, _STRIP_ROWS)
        self.ranks = [np.ascontiguousarray(ranks[:, i : i + _STRIP_ROWS]) for i in strips]

    def windows(self, centres: np.ndarray, width: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first rank of a window in each projection, and how many ranks it holds."""
        first = np.arange(PROJECTIONS) * len(self.vectors)
        left = np.searchsorted(self.values, centres - width + self.shift) - first
        right = np.searchsorted(self.values, centres + width + self.shift, "right") - first
        return left, right - left

    def collisions(self, left: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many windows each vector lies."""
        kind = self.ranks[0].dtype
        # a rank below the window wraps around and so lies beyond it
        left, size, counts = left.astype(kind)[:, None], size.astype(kind)[:, None], []
        for ranks in self.ranks:
            inside = np.less(ranks - left, size)
            counts.append(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8))
        return np.concatenate(counts)

    def search(
        self, queries: np.ndarray, k: int, skip: np.ndarray, within: np.ndarray | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (``skip``: its own row here, or -1) the verified rows and their cosines.

        ``within``: the distance beyond which a query wants no rows; without one (NaN), windows are
        widened until its k nearest are found.
        """
        n, need = len(self.vectors), threshold()
        centres, last = queries @ self.lines, 0.0
        for q, (centre, query) in enumerate(zip(centres, queries)):
            known = within is not None and not np.isnan(within[q])
            seen = np.zeros(n, bool)
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            if skip[q] >= 0:
                seen[skip[q]] = True
            # from a little below where the query before ended: wider than needed only verifies more
            width = within[q] * REACH if known else max(FIRST_WIDTH, last / WIDEN**2)
            while True:
                wide = width >= _ALL
                near = ~seen if wide else (self.collisions(*self.windows(centre, width)) >= need) & ~seen
                new = np.flatnonzero(near)
                seen[new] = True
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new] @ query])
                if wide or known:
                    break
                if len(rows) >= k and sqrt(max(0.0, 2 - 2 * np.partition(scores, -k)[-k])) <= width / REACH:
                    break
                width *= WIDEN
            last = min(width, _ALL)
            yield rows, scores


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column, scaled to unit length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _found(
    ids: np.ndarray, vectors: np.ndarray, asked_ids: np.ndarray, asked: np.ndarray, k: int, within: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its ``k`` nearest found in a block, each id once."""
    order = np.argsort(ids, kind="stable")
    ids, index = ids[order], Projections(vectors[order])
    place = np.minimum(np.searchsorted(ids, asked_ids), len(ids) - 1)
    skip = np.where(ids[place] == asked_ids, place, -1)
    # other rows of a query's own id are found and then left: ask for as many more
    own_rows = np.searchsorted(ids, asked_ids, "right") - np.searchsorted(ids, asked_ids, "left")
    more = int(max(own_rows.max(initial=0) - 1, 0))
    # and a block where ids repeat for enough different ones
    more += len(ids) - len(np.unique(ids)) if len(ids) else 0
    for query_id, query, (found, scores) in zip(asked_ids, asked, index.search(asked, k + more, skip, within)):
        found, scores = found[ids[found] != query_id], scores[ids[found] != query_id]
        if len(found) > k + more:
            found = found[scores >= np.partition(scores, -k - more)[-k - more] - 1e-9]
        # sums of each row alone, so that equal vectors get equal scores
        scores = (index.vectors[found] * query).sum(1)
        best = np.lexsort((ids[found], -scores))
        _, first = np.unique(ids[found[best]], return_index=True)
        best = best[np.sort(first)[:k]]
        yield ids[found[best]], scores[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row, by cosine.

    ``vectors`` has vec_id and embedding; other columns are ignored. Null or zero vectors, and
    those with null or non-finite components, take no part; a query meets vectors of its own
    length only, and never rows of its own vec_id. Ties go to the smaller vec_id. Queries go
    in groups to blocks of vectors; from each block come ``k`` rows per query at most.
    Repeated rows (equal vec_id and vector) are one row; a vec_id with several vectors is
    found by its nearest one, and asks with each of them, its results merged.
    """
    vec = F.col("embedding")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.select("vec_id", vec.cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(
        F.col("vec_id").isNotNull() & vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)
    )
    good = good.dropDuplicates(["vec_id", "embedding"])  # repeated rows are one vector; map-side first
    rows = store(spread(good.withColumn("dims", F.size("embedding"))), "ann-vectors")
    pivots = _pivots(rows)
    placed, blocks = _placed(rows, pivots)

    def at_home(block: pa.Table) -> pa.Table:
        asks = block.filter(block["asks"]).sort_by("vec_id")
        if not len(asks):
            return home_schema.empty_table()
        near = _found(block["vec_id"].to_numpy(), _units(block["embedding"]), asks["vec_id"].to_numpy(), _units(asks["embedding"]), k)
        found, scores = zip(*near)
        # a little more than the k-th best, for rounding
        within = [sqrt(max(0.0, 2 - 2 * s[k - 1])) + 1e-9 if len(s) == k else None for s in scores]
        columns = [asks["dims"], asks["block"], asks["vec_id"], asks["embedding"], found, scores, within]
        return pa.Table.from_arrays([pa.array(c, t) if isinstance(c, (list, tuple)) else c.cast(t) for c, t in zip(columns, home_schema.types)], schema=home_schema)

    home_schema = pa.schema(
        [("dims", pa.int32()), ("block", pa.int32()), ("query_id", pa.int64()), ("embedding", pa.list_(pa.float64()))]
        + [("found", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("within", pa.float64())]
    )
    kinds = "dims int, block int, query_id bigint, embedding array<double>, found array<bigint>, scores array<double>, within double"
    home = placed.groupBy("dims", "block").applyInArrow(at_home, kinds)
    home = store(home, "ann-home") if pivots else home
    pairs = F.explode(F.arrays_zip("found", "scores")).alias("pair")
    found = home.select("query_id", pairs).select("query_id", F.col("pair.found").alias("vec_id"), F.col("pair.scores").alias("score"))
    if pivots:
        found = found.union(_away(placed, home, pivots, blocks, k))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length, for vectors that fill more than a block: a few of them, by a hash, as directions."""
    sizes = rows.groupBy("dims").count().filter(F.col("count") > BLOCK_ROWS).collect()
    cells = {r["dims"]: min(-(-r["count"] // BLOCK_ROWS), MAX_CELLS) for r in sizes}
    if not cells:
        return {}
    by_hash = Window.partitionBy("dims").orderBy("hash", "embedding")
    drawn = (
        rows.filter(F.col("dims").isin(list(cells)))
        .select("dims", "embedding", F.xxhash64("vec_id", F.lit(2)).alias("hash"))
        .withColumn("n", F.row_number().over(by_hash))
        .filter(F.col("n") <= max(cells.values()))
        .select("dims", "n", "embedding")
        .toArrow()
        .sort_by("n")
    )
    dims, n = drawn["dims"].to_numpy(), drawn["n"].to_numpy()
    return {d: _units(drawn.filter(pa.array((dims == d) & (n <= c)))["embedding"]) for d, c in cells.items()}


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> tuple[DataFrame, Directions]:
    """``rows`` with their block, and by length its directions: pivot, blocks, widest and least angle."""
    if not pivots:
        return rows.withColumn("block", F.lit(0)), {}

    def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cell, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.intersect1d(dims, list(pivots)):
                own = np.flatnonzero(dims == d)
                cosines = _units(batch.column("embedding").take(pa.array(own))) @ pivots[d].T
                cell[own] = cosines.argmax(1)
                angle[own] = np.arccos(np.clip(cosines.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    kinds = "vec_id bigint, embedding array<double>, asks boolean, dims int, cell int, angle double"
    dealt = store(rows.select("vec_id", "embedding", "asks", "dims").mapInArrow(nearest_pivot, kinds), "ann-placed")
    found = dealt.filter(F.col("dims").isin(list(pivots))).groupBy("dims", "cell")
    found = found.agg(F.count("*").alias("n"), F.max("angle").alias("far"), F.min("angle").alias("near")).orderBy("dims", "cell").collect()
    blocks, table, last = {d: [] for d in pivots}, [], dict.fromkeys(pivots, 0)
    for r in found:
        parts = -(-r["n"] // BLOCK_ROWS)
        table.append((r["dims"], r["cell"], last[r["dims"]], parts))
        last[r["dims"]] += parts
        blocks[r["dims"]].append((r["cell"], parts, r["far"], r["near"]))
    first = rows.sparkSession.createDataFrame(table, "dims int, cell int, first int, parts int")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")).cast("int")
    placed = dealt.join(F.broadcast(first), ["dims", "cell"], "left").withColumn("block", F.coalesce(block, F.lit(0)))
    return placed.select("vec_id", "embedding", "asks", "dims", "block"), blocks


def _visits(home: DataFrame, pivots: dict[int, np.ndarray], blocks: Directions) -> DataFrame:
    """The queries of lengths that fill several blocks, with the blocks besides their own that may hold as near a vector."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, own = batch.column("dims").to_numpy(), batch.column("block").to_numpy()
            within = batch.column("within").to_numpy(zero_copy_only=False)
            reach = np.where(np.isnan(within), np.pi, 2 * np.arcsin(np.clip(within / 2, 0, 1)))
            goes: list[np.ndarray] = [np.zeros(0, np.int32)] * len(dims)
            for d in np.unique(dims):
                cell, parts, far, near = (np.array(x) for x in zip(*blocks[d]))
                mine = np.flatnonzero(dims == d)
                angle = np.arccos(np.clip(_units(batch.column("embedding").take(pa.array(mine))) @ pivots[d][cell].T, -1, 1))
                meets = np.maximum(angle - far, near - angle) <= reach[mine, None] + 1e-6
                meets = np.repeat(meets, parts, axis=1)
                meets[np.arange(len(mine)), own[mine]] = False
                for at, row in zip(mine, meets):
                    goes[at] = np.flatnonzero(row).astype(np.int32)
            taken = [batch.column(c) for c in ("dims", "query_id", "embedding", "within")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(goes, pa.list_(pa.int32()))], names=["dims", "vec_id", "embedding", "within", "blocks"])

    asking = home.filter(F.col("dims").isin(list(pivots)))
    return asking.mapInArrow(visits, "dims int, vec_id bigint, embedding array<double>, within double, blocks array<int>")


def _away(placed: DataFrame, home: DataFrame, pivots: dict[int, np.ndarray], blocks: Directions, k: int) -> DataFrame:
    """(query_id, vec_id, score) found outside the block that a query lies in."""

    def search(block: pa.Table) -> pa.Table:
        asks = block.filter(block["ask"])
        own = block.filter(pc.invert(block["ask"]))
        if not len(asks) or not len(own):
            return schema.empty_table()
        asked_ids, within = asks["vec_id"].to_numpy(), asks["within"].to_numpy()
        near = _found(own["vec_id"].to_numpy(), _units(own["embedding"]), asked_ids, _units(asks["embedding"]), k, within)
        found, scores = zip(*near)
        query_ids = np.repeat(asked_ids, [len(f) for f in found])
        return pa.Table.from_arrays([pa.array(x) for x in (query_ids, np.concatenate(found), np.concatenate(scores))], schema=schema)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    going = _visits(home, pivots, blocks)
    groups = -(-max(home.count(), 1) // GROUP_QUERIES)
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    going = going.select("dims", F.explode("blocks").alias("block"), group.alias("group"), "vec_id", "embedding", "within", F.lit(True).alias("ask"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    rows = placed.filter(F.col("dims").isin(list(pivots)))
    rows = rows.select("dims", "block", every.alias("group"), "vec_id", "embedding", F.lit(None).cast("double").alias("within"), F.lit(False).alias("ask"))
    return rows.union(going).groupBy("dims", "block", "group").applyInArrow(search, "query_id bigint, vec_id bigint, score double")
