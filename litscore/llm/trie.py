"""A prefix trie of conversations by a splitter skeleton.

Conversations are turned into sequences of 128-bit turn keys, range-partitioned and sorted
by (sequence, conv_id). The members of a trie node are then one contiguous run of that
order, so a node whose run crosses a partition boundary is a prefix of the sequence at
that boundary. Those prefixes, the skeleton, are found from the first and last sequence of
each partition and broadcast as a small trie; the bound is the number of partitions times
the depth of the conversations at their boundaries.

Each sorted shard walks its rows once with a stack of open nodes and finishes every node
that is not in the skeleton: members, children, leaves, saved tokens and the hash of the
conversations that end there. Skeleton nodes get partial aggregates from every shard,
which are summed by node; the conversations ending at a skeleton node are hashed in the
order of their ids by a stream per node. No group is gathered in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litscore.llm.common import whole_groups

#: Turns of the conversation c - c % GROUP that every conversation c takes first.
GROUP = 100
#: h(c) = crc32(decimal c) % SHARED_MOD is the number of such turns.
SHARED_MOD = 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_WALK = T.StructType([
    T.StructField("kind", T.StringType()),  # node: a finished node; part: a skeleton node's share; end: a conversation ending at one
    T.StructField("conv_id", T.LongType()),
    T.StructField("depth", T.LongType()),
    T.StructField("parent_conv_id", T.LongType()),
    T.StructField("parent_skel", T.LongType()),
    T.StructField("skel", T.LongType()),
    T.StructField("n_convs", T.LongType()),
    T.StructField("n_children", T.LongType()),
    T.StructField("n_leaves", T.LongType()),
    T.StructField("saved_tokens", T.LongType()),
    T.StructField("ends", T.LongType()),
    T.StructField("last_chars", T.LongType()),
    T.StructField("ends_sha256", T.StringType()),
])
_NAMES = [f.name for f in _WALK.fields]


def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): for every conv_id c the first h(c) turns of c - c % GROUP, then c's turns after its first h(c).

    Turns are ordered by turn (null first), then role and text, so repeated rows keep an
    order; null role and text are empty; rows of a null conv_id are left out.
    """
    t = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("k", F.row_number().over(order) - 1).drop("turn")
    ids = t.groupBy("c").agg(F.count(F.lit(1)).alias("len")).select(
        "c", "len", (F.crc32(F.col("c").cast("string")) % SHARED_MOD).alias("h"), (F.col("c") - F.col("c") % GROUP).alias("p"),
    )
    lengths = ids.select(F.col("c").alias("p"), F.col("len").alias("len_p"))
    ids = ids.join(lengths, "p", "left").select("c", "h", "p", F.least("h", F.coalesce("len_p", F.lit(0))).alias("taken"))
    head = t.where(F.col("k") < SHARED_MOD - 1).select(F.col("c").alias("p"), "k", "role", "text")
    shared = ids.join(head, "p").where(F.col("k") < F.col("h")).select("c", F.col("k").alias("pos"), "role", "text")
    own = t.join(ids.select("c", "h", "taken"), "c").where(F.col("k") >= F.col("h"))
    own = own.select("c", (F.col("taken") + F.col("k") - F.col("h")).alias("pos"), "role", "text")
    return shared.unionByName(own).withColumnRenamed("c", "conv_id")


def sequences(rebuilt: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """(conv_id, seq array<struct<a, b>>, chars array<long>): turn keys and code points of each text, by position."""
    turns = rebuilt.select(
        "conv_id", "pos",
        F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("turn"), "text", "role").alias("b"),
        F.char_length("text").cast("long").alias("n"),
    )
    packed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n"))).alias("t"))
    packed = conv_ids.join(packed, "conv_id", "left")
    return packed.select(
        "conv_id",
        F.coalesce(F.transform("t", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("seq"),
        F.coalesce(F.transform("t", lambda x: x["n"]), F.array().cast("array<bigint>")).alias("chars"),
    )


def _pairs(seq) -> list[tuple[int, int]]:
    return [(x["a"], x["b"]) for x in seq]


def skeleton(bounds: list[tuple[int, list, list]]) -> dict[tuple[int, tuple[int, int]], int]:
    """The trie of the prefixes that the first and last sequences of neighbouring shards share; node 0 is the root."""
    trie: dict[tuple[int, tuple[int, int]], int] = {}
    last = None
    for _, first, final in sorted(bounds, key=lambda b: b[0]):
        if last is not None:
            node = 0
            for x, y in zip(last, first):
                if x != y:
                    break
                node = trie.setdefault((node, x), len(trie) + 1)
        last = final
    return trie


def walk(rows: Iterator[dict], trie: dict) -> Iterator[dict]:
    """Rows of finished nodes, skeleton shares and skeleton ends of one sorted shard."""

    class Frame:
        __slots__ = ("key", "depth", "skel", "chars", "ends", "sha", "least", "n", "kids", "leaves", "saved", "pending")

        def __init__(self, key, depth, skel, chars):
            self.key, self.depth, self.skel, self.chars = key, depth, skel, chars
            self.ends, self.sha, self.least = 0, hashlib.sha256(), None
            self.n = self.kids = self.leaves = self.saved = 0
            self.pending: list[dict] = []

    def row(**values):
        return dict.fromkeys(_NAMES) | values

    def close(frame, parent):
        if frame.skel is not None:
            yield row(kind="part", skel=frame.skel, conv_id=frame.least, depth=frame.depth, n_convs=frame.n, n_children=frame.kids,
                      n_leaves=frame.leaves, saved_tokens=frame.saved, ends=frame.ends, last_chars=frame.chars)
            return
        leaves = frame.leaves if frame.kids else 1
        saved = (frame.n - 1) * frame.chars + frame.saved
        for child in frame.pending:
            child["parent_conv_id"] = frame.least
            yield child
        done = row(kind="node", conv_id=frame.least, depth=frame.depth, n_convs=frame.n, n_children=frame.kids, n_leaves=leaves,
                   saved_tokens=saved, ends_sha256=frame.sha.hexdigest())
        if parent.skel is None:
            parent.pending.append(done)
        else:
            done["parent_skel"] = parent.skel
            yield done
        parent.kids += 1
        parent.n += frame.n
        parent.least = frame.least if parent.least is None else min(parent.least, frame.least)
        parent.leaves += leaves
        parent.saved += saved

    stack = [Frame(None, 0, 0, 0)]
    for r in rows:
        keys, chars, c = r["keys"], r["chars"], r["conv_id"]
        same = 0
        while same < len(keys) and same + 1 < len(stack) and stack[same + 1].key == keys[same]:
            same += 1
        while len(stack) > same + 1:
            frame = stack.pop()
            yield from close(frame, stack[-1])
        for d in range(same, len(keys)):
            parent = stack[-1]
            skel = trie.get((parent.skel, keys[d])) if parent.skel is not None else None
            stack.append(Frame(keys[d], d + 1, skel, chars[d]))
        top = stack[-1]
        top.ends += 1
        top.n += 1
        top.least = c if top.least is None else min(top.least, c)
        if top.skel is None:
            top.sha.update(f"{',' if top.ends > 1 else ''}{c}".encode())
        else:
            yield row(kind="end", skel=top.skel, conv_id=c)
    while len(stack) > 1:
        frame = stack.pop()
        yield from close(frame, stack[-1])
    yield from close(stack[0], None)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the comma-joined ids of each skeleton node, from rows sorted by (skel, conv_id)."""
    out_skel, out_sha = [], []
    for group in whole_groups(batches, ["skel"]):
        sha = hashlib.sha256()
        first = True
        for b in group.column("conv_id").chunks:
            ids = b.to_pylist()
            if ids:
                sha.update(((("" if first else ",") + ",".join(map(str, ids)))).encode())
                first = False
        out_skel.append(group.column("skel")[0].as_py())
        out_sha.append(sha.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(out_skel, pa.int64()), pa.array(out_sha, pa.string())], names=["skel", "ends_sha256"])


def conversation_trie(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per trie node of the rebuilt conversations (see ``rebuild``).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves (childless nodes of its subtree, itself included), saved_tokens (over its
    subtree, (n_convs - 1) times the code points of a node's last text; the root has none),
    ends_sha256 (sha256 of the ascending decimal ids of the conversations that end there,
    comma-joined; none: the hash of the empty string). A conversation without turns is a
    member of the root alone. An empty table has no nodes. Turns are equal when role and
    text are (by 128-bit keys).
    """
    spark = conversations.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rebuilt = rebuild(conversations)
    conv_ids = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    seqs = sequences(rebuilt, conv_ids)
    ordered = seqs.repartitionByRange(partitions, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").checkpoint()

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        for b in batches:
            seqs = b.column("seq")
            if len(seqs):
                first = first if first is not None else seqs[0].as_py()
                last = seqs[len(seqs) - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "last": last}],
                                             schema=pa.schema([("part", pa.int64()), ("first", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("last", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]))

    bounds = ordered.select("seq").mapInArrow(ends_of, "part long, first array<struct<a:bigint,b:bigint>>, last array<struct<a:bigint,b:bigint>>").collect()
    trie = skeleton([(r["part"], _pairs(r["first"]), _pairs(r["last"])) for r in bounds])
    shared = spark.sparkContext.broadcast(trie)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for c, seq, chars in zip(b.column("conv_id").to_pylist(), b.column("seq").to_pylist(), b.column("chars").to_pylist()):
                    yield {"conv_id": c, "keys": [(x["a"], x["b"]) for x in seq], "chars": chars}

        out = []
        for r in walk(rows(), shared.value):
            out.append(r)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    walked = ordered.mapInArrow(shard, _WALK).checkpoint()
    parts = walked.where("kind = 'part'").groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("last_chars").alias("last_chars"),
    ).collect()
    ends = walked.where("kind = 'end'").select("skel", "conv_id")
    ends = ends.repartition("skel").sortWithinPartitions("skel", "conv_id").mapInArrow(_hash_ends, "skel long, ends_sha256 string")
    sha = {r["skel"]: r["ends_sha256"] for r in ends.collect()}
    skel_rows = _skeleton_rows(trie, {r["skel"]: r for r in parts}, sha)
    resolved = spark.createDataFrame(
        [(j, r["conv_id"]) for j, r in skel_rows.items()], "parent_at long, skel_conv_id long"
    )
    nodes = walked.where("kind = 'node'").join(F.broadcast(resolved), F.col("parent_skel") == F.col("parent_at"), "left")
    nodes = nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "skel_conv_id").alias("parent_conv_id"),
                         "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    top = spark.createDataFrame([tuple(r[k] for k in _OUT) for r in skel_rows.values()], ", ".join(f"{k} {_KIND[k]}" for k in _OUT))
    return nodes.unionByName(top)


_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_KIND = dict.fromkeys(_OUT, "long") | {"ends_sha256": "string"}
_ARROW = pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in _WALK.fields])


def _skeleton_rows(trie: dict, parts: dict, sha: dict) -> dict[int, dict]:
    """Skeleton nodes whole: shares summed, skeleton children added, subtree sums carried up from the deepest."""
    parent = {0: None} | {j: p for (p, _), j in trie.items()}
    kids: dict[int, list[int]] = {}
    for j, p in parent.items():
        if p is not None:
            kids.setdefault(p, []).append(j)
    done: dict[int, dict] = {}
    for j in sorted(parts, key=lambda j: -parts[j]["depth"]):
        share = parts[j]
        own = [done[k] for k in kids.get(j, []) if k in done]
        n_convs = share["n_convs"] + sum(k["n_convs"] for k in own)
        if not n_convs:
            continue
        n_children = share["n_children"] + len(own)
        done[j] = {
            "conv_id": min([x for x in [share["conv_id"], *(k["conv_id"] for k in own)] if x is not None]),
            "depth": share["depth"], "n_convs": n_convs, "n_children": n_children,
            "n_leaves": (share["n_leaves"] + sum(k["n_leaves"] for k in own)) if n_children else 1,
            "saved_tokens": (n_convs - 1) * share["last_chars"] + share["saved_tokens"] + sum(k["saved_tokens"] for k in own),
            "ends_sha256": sha.get(j, EMPTY_SHA), "parent": parent[j],
        }
    for r in done.values():
        r["parent_conv_id"] = done[r["parent"]]["conv_id"] if r["parent"] is not None else None
    return done
