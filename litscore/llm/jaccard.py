"""Groups of near-duplicate documents: all pairs of word-shingle sets with high Jaccard similarity.

A document that is similar to another shares at least SHARE percent of its shingles with it,
so documents with fewer shingles that any other document has are done. Of the rest, those
that could be similar are brought together: under any order of the shingles, two similar
sets share one within the first size - ceil(share * size) + 1 of each. Shingles of one
document alone come first, then those of few documents, so that what is common in the
corpus ties only documents that have little else. Documents tied by such keys within
bands of size form cells.

A cell is joined by signature trees. Leaves are documents in order of size; a node holds the
OR of the bitmaps of its documents and the range of their sizes. Two trees are traversed
together, and a pair of nodes is left as soon as the largest possible overlap, from sizes and
common bits, is too small, or all is known to be one group. This is done twice: with the
bitmaps alone, a fraction of the size of the sets, to part what may be similar from what
cannot be; then within what is left, where pairs of leaves are compared by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscore.llm.common import WordHasher, give_back, mix, slices, store, whole_groups
from litscore.llm.components import Forest, components
from litscore.llm.shared import bucketed, degrees, merged, narrow, positions, shared_hashes

SHINGLE_WORDS = 5
#: Least similarity in percent: 100 * intersection >= SHARE * union.
SHARE = 75
#: A cell of more documents is split into blocks of about half as many, and these are paired.
CELL_DOCS = 1024
LEAF_DOCS, FANOUT = 16, 8


class Shingles:
    """Hashes of the word shingles of the texts of a slice; words are folded to lower case (A-Z)."""

    def __init__(self, words: int = SHINGLE_WORDS) -> None:
        self.hasher, self.words = WordHasher(lower=True), words
        rng = np.random.default_rng(55)
        self.factors = rng.integers(1, 1 << 62, words, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, hash) of each shingle; a text of fewer words has one of all its words."""
        hashes, counts = self.hasher(data, ends)
        n = np.diff(counts)
        size = np.where(n >= self.words, n - self.words + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(len(n)), size)
        first = np.repeat(counts[:-1] - (size.cumsum() - size), size) + np.arange(len(text))
        total = np.zeros(len(text), np.uint64)
        padded = np.append(hashes, np.zeros(self.words, np.uint64))
        for j in range(self.words):
            word = padded[first + j]
            if j:  # only short texts lack a word here
                word = np.where(n[text] > j, word, np.uint64(0x5851F42D4C957F2D))
            total = mix(total + word * self.factors[j])
        return text, total


def _distinct(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def required(a, b, share: int = SHARE):
    """Least intersection of sets of these sizes that are similar."""
    return -(-share * (a + b) // (100 + share))


class Tree:
    """A signature tree over documents in order of size."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, slack: np.ndarray) -> None:
        self.levels = []
        low = np.arange(0, len(sizes), LEAF_DOCS)
        high = np.minimum(low + LEAF_DOCS, len(sizes))
        step = LEAF_DOCS
        while True:
            self.levels.append(
                (low, high, np.bitwise_or.reduceat(bitmaps, low, 0), sizes[low], sizes[high - 1], np.maximum.reduceat(slack, low))
            )
            if len(low) == 1:
                break
            step *= FANOUT
            low = np.arange(0, len(sizes), step)
            high = np.minimum(low + step, len(sizes))

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))


def bitmap(hashes: np.ndarray, width: int) -> np.ndarray:
    """Bits at the hashes modulo ``width``, a power of two of at least 64, as 64-bit words."""
    out = np.zeros(width // 64, np.uint64)
    bits = hashes % np.uint64(width)
    np.bitwise_or.at(out, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
    return out


def fitting_width(n: int) -> int:
    """Bits for a set of ``n``, so that a quarter of them or less is taken."""
    return 1 << min(max((4 * n - 1).bit_length(), 8), 18)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """A bitmap reduced to ``width``: equal to that made with it at once."""
    return np.bitwise_or.reduce(words.reshape(-1, width // 64), axis=0)


def tree_join(
    sizes: np.ndarray,
    counts: np.ndarray,
    bitmaps: list[np.ndarray],
    sets: list[np.ndarray] | None = None,
    side: np.ndarray | None = None,
    share: int = SHARE,
) -> np.ndarray:
    """Smallest index of the group of each document; documents are in order of ``sizes``.

    ``counts`` and ``bitmaps`` are those of the shingles that others have too, ``sizes``
    those of the whole sets. With ``sets`` (ascending) a pair is compared in full, without
    it all pairs count that can be similar. With ``side`` only pairs across sides count.
    """
    n, forest = len(sizes), Forest(len(sizes))
    width = 64 * min(map(len, bitmaps))
    bits = np.array([folded(b, width) for b in bitmaps])
    slack = counts - np.bitwise_count(bits).sum(1, dtype=np.int64)
    tree = Tree(sizes, bits, slack)

    def possible(p: tuple, i: int, q: tuple, j: int) -> bool:
        """Whether documents under the nodes can be similar: sizes first, then common bits."""
        a, b = p[4][i], q[3][j]  # the largest of the smaller ones, the smallest of the larger ones
        if 100 * a < share * b:
            return False
        common = int(np.bitwise_count(p[2][i] & q[2][j]).sum()) + int(min(p[5][i], q[5][j]))
        return common >= required(p[3][i], q[3][j], share)

    def one_group(low: int, high: int) -> int:
        root = forest.root(low)
        return root if all(forest.root(k) == root for k in range(low + 1, high)) else -1

    def similar(a: int, b: int, need: int) -> bool:
        if sets is None:
            return True
        both = np.concatenate([sets[a], sets[b]])
        both.sort()
        return int((both[1:] == both[:-1]).sum()) >= need

    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        here = tree.levels[level]
        if not possible(here, i, here, j):
            continue
        if level:
            own = [(level - 1, a, b) for a in tree.children(level, i) for b in tree.children(level, j) if a <= b]
            # near pairs first: they make groups early
            stack += sorted(own, key=lambda p: p[1] - p[2])
            continue
        (a0, a1), (b0, b1) = (here[0][i], here[1][i]), (here[0][j], here[1][j])
        root = one_group(a0, a1)
        if root >= 0 and root == one_group(b0, b1):
            continue
        need = required(sizes[a0:a1, None], sizes[None, b0:b1], share)
        most = np.bitwise_count(bits[a0:a1, None, :] & bits[None, b0:b1, :]).sum(2, dtype=np.int64)
        most += np.minimum(slack[a0:a1, None], slack[None, b0:b1])
        for x, y in zip(*np.nonzero(most >= need)):
            a, b = int(a0 + x), int(b0 + y)
            if a >= b or (side is not None and side[a] == side[b]) or forest.root(a) == forest.root(b):
                continue
            if similar(a, b, need[x, y]):
                forest.join(a, b)
    return forest.roots()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, and for those that can be similar to another
    ``own`` (its shared shingles, ascending, as bytes), their bitmap ``bits``, ``keys`` (the
    rarest of them) and two hashes of the set;
    ``twin`` is a document of the same set in the same bucket, which then stands for it."""
    dealt, n = bucketed(docs)
    shared = shared_hashes(dealt, n, Shingles, "jaccard-shingles", counted=True)
    schema = "doc_id bigint, n_shingles bigint, twin bigint, f1 bigint, f2 bigint, own binary, bits binary, keys array<bigint>"

    def collect(texts: pa.Table, found: pa.Table) -> pa.Table:
        shingles, known, degree = Shingles(), merged(found), degrees(found)
        ids = texts.column("doc_id").combine_chunks()
        rows: list[tuple] = []
        seen: dict[tuple, int] = {}
        order_rows = np.argsort(ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), kind="stable")
        texts, ids = texts.take(pa.array(order_rows)), ids.take(pa.array(order_rows))
        all_ids = ids.to_pylist()
        for first, last, data, ends in slices(texts.column("text")):
            text, hashes = _distinct(*shingles(data, ends))
            at = positions(narrow(hashes, n), known)
            common = at >= 0
            cuts = np.searchsorted(text, np.arange(last - first + 1))
            sizes = np.diff(cuts)
            with_others = np.diff(np.concatenate([[0], common.cumsum()])[cuts])
            for i in range(last - first):
                doc_id, size, count = all_ids[first + i], int(sizes[i]), int(with_others[i])
                if doc_id is None or not size or 100 * count < SHARE * size:
                    rows.append((doc_id, size, *[None] * 6))
                    continue
                whole = hashes[cuts[i] : cuts[i + 1]]
                mark = (size, int(whole.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(whole)).view(np.int64)))
                if mark in seen:
                    rows.append((doc_id, size, seen[mark], *[None] * 5))
                    continue
                seen[mark] = doc_id
                mine = at[cuts[i] : cuts[i + 1]]
                own = whole[mine >= 0]
                rare = np.argsort(degree[mine[mine >= 0]], kind="stable")  # equal ones by hash
                prefix = size - -(-SHARE * size // 100) + 1 - (size - count)
                bits = bitmap(own, fitting_width(count)).tobytes()
                rows.append((doc_id, size, None, mark[1], mark[2], own.tobytes(), bits, own[rare[:prefix]].view(np.int64)))
        give_back()
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = ["doc_id", "n_shingles", "twin", "f1", "f2", "own", "bits", "keys"]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return store(dealt.groupBy("bucket").cogroup(shared.groupBy("origin")).applyInArrow(collect, schema), "jaccard-sets")


#: Groups of rows that are compared with each other.
_CELL = ["cell", "band", "low", "high"]


def _bands():
    """Similar sizes differ by less than a third, so they share one of two neighbouring bands."""
    band = F.floor(F.log("n_shingles") / F.log(F.lit(100 / SHARE)) + 1e-9).cast("int")
    return F.array(band, band + 1)


def _places(able: DataFrame, groups: DataFrame, banded: bool) -> DataFrame:
    """(doc_id, cell, band, low, high, block): where each document goes, as ids alone.

    ``groups`` are components. Groups of up to CELL_DOCS stay whole, unless ``banded``; the
    others are cut by bands of size, and a band of more documents into pairs of blocks.
    """
    cells = store(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("cell")), "jaccard-cells")
    whole = cells.groupBy("cell").agg((F.count("*") <= (0 if banded else CELL_DOCS)).alias("whole"))
    members = (
        able.select("doc_id", "n_shingles")
        .join(cells.hint("merge"), "doc_id")
        .join(whole.hint("merge"), "cell")
        .select("doc_id", "cell", F.explode(F.when(F.col("whole"), F.array(F.lit(0))).otherwise(_bands())).alias("band"))
    )
    members = store(members, "jaccard-members")
    crowds = members.groupBy("cell", "band").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.when(F.col("n") > CELL_DOCS, F.ceil(F.col("n") * 2 / CELL_DOCS)).otherwise(1).cast("int")
    places = (
        members.join(crowds.select("cell", "band", blocks.alias("blocks")).hint("merge"), ["cell", "band"])
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select("doc_id", *_CELL, "block")
    )
    return store(places, "jaccard-places")


def _links(able: DataFrame, places: DataFrame, in_full: bool, name: str) -> DataFrame:
    """(a, b): links that make the groups of each cell, by bitmaps alone or ``in_full``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, _CELL):
            if len(rows) < 2:
                continue
            doc, size = rows.column("doc_id").to_numpy(), rows.column("n_shingles").to_numpy()
            order = np.lexsort((doc, size))
            raw, count = rows.column("data").to_pylist(), rows.column("n_shared").to_numpy()[order]
            data = [np.frombuffer(raw[i], np.uint64) for i in order]
            if in_full:
                # one width for the cell: sizes in it differ little, or it has few documents
                width = fitting_width(max(map(len, data)))
                bits, sets = [bitmap(d, width) for d in data], data
            else:
                bits, sets = data, None
            apart = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
            side = rows.column("block").to_numpy()[order] if apart else None
            root = tree_join(size[order], count, bits, sets, side)
            tied = np.flatnonzero(root != np.arange(len(root)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(doc[order][tied]), pa.array(doc[order][root[tied]])], names=["a", "b"])

    shared = (F.length("own") / 8).cast("bigint").alias("n_shared")
    data = F.col("own" if in_full else "bits").alias("data")
    paired = able.select("doc_id", "n_shingles", shared, data).join(places.hint("merge"), "doc_id")
    paired = paired.select(*_CELL, "block", "doc_id", "n_shingles", "n_shared", "data")
    return store(paired.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(compare, "a bigint, b bigint"), name)


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` (doc_id, text; others ignored).

    component_id is the smallest doc_id reachable by links. A null or empty text has no
    shingles and is linked with nothing, nor is a row without doc_id (its component is null).
    Rows of equal doc_id share their component.
    """
    sets = shingle_sets(docs)
    able = sets.filter(F.col("own").isNotNull())
    marks = ["n_shingles", "f1", "f2"]
    heads = store(able.groupBy(*marks).agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "jaccard-heads")
    copies = able.select("doc_id", *marks).join(heads.filter("n > 1").hint("merge"), marks).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    twins = sets.filter(F.col("twin").isNotNull()).select(F.col("doc_id").alias("a"), F.col("twin").alias("b"))
    leads = able.select("doc_id", "n_shingles", "keys").join(
        heads.select(F.col("head").alias("doc_id")).hint("merge"), "doc_id", "left_semi"
    )
    keyed = leads.select("doc_id", F.explode(_bands()).alias("band"), "keys").select(
        "doc_id", "band", F.explode("keys").alias("key")
    ).select("doc_id", F.xxhash64("key", "band").alias("key"))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    ties = keyed.join(least.hint("merge"), "key").filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    tied = components(store(ties.distinct(), "jaccard-ties"), "jaccard-tied")
    possible = components(_links(able, _places(able, tied, True), False, "jaccard-possible"), "jaccard-possible")
    links = _links(able, _places(able, possible, False), True, "jaccard-links")
    groups = components(links.union(copies).union(twins), "jaccard-groups").withColumnsRenamed({"node": "doc_id", "component": "component_id"})
    return (
        sets.select("doc_id", "n_shingles")
        .join(groups.hint("merge"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )
