"""Mix sources to target weights.

The words of each source, in a fixed order of its documents, form one stream that is packed
into blocks of a fixed length. Every output shard draws how many of its slots each source
fills: what each source is still owed is shared out, whole slots first and the rest by a
multinomial draw. The slots of a source are numbered through and mapped by a pseudorandom
permutation of its block numbers, a new one for each pass over the source; blocks and slots
are then joined by block number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscore.llm.common import free_name, store

#: Words of a document: runs of characters other than space and 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights dealt to the sources in order of their names, again and again.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own words.
MAX_REPEATS = 3
#: Largest block; sources of fewer than 256 such blocks get blocks of a 256th of their words.
BLOCK_WORDS = 64
SHARDS = 64
#: Documents of a source are put in this many runs, whose lengths are summed before they are ordered.
RUNS = 1024
_SPAN = 4096
_TASK_SLOTS = 1 << 18


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Words due to each source: 100% of all words by weight, ``most`` times its own at most.

    What a source cannot give is shared by weight among the others, until none is above.
    Names are ordered by code point, null last.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in names if s in open_ and weight[s] * share > most * sizes[s]]
        if not full:
            out |= {s: weight[s] * share for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def draw_slots(due: np.ndarray, limit: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard, shards in rows; never more than ``limit`` in all.

    Each shard takes what is due up to its end and not drawn yet: the whole numbers as they
    are, the remaining slots by a multinomial draw over the fractions.
    """
    drawn, rows = np.zeros(len(due), np.int64), []
    for shard in range(shards):
        owed = np.maximum(due * (shard + 1) / shards - drawn, 0)
        whole = np.floor(owed).astype(np.int64)
        rest = owed - whole
        n = int(round(rest.sum()))
        if n and rest.sum() > 0:
            whole += np.random.default_rng([seed, shard]).multinomial(n, rest / rest.sum())
        whole = np.minimum(whole, limit - drawn)
        rows.append(whole)
        drawn += whole
    return np.array(rows).reshape(shards, len(due))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places (Feistel rounds, cycle walking)."""
    if n <= 1:
        return np.zeros_like(index)
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng([key, n]).integers(0, 1 << 62, 4, np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) >> np.uint64(7)) & mask
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place_documents(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """(doc_id, source, size, start): where each document's words start in its source's stream.

    The order is that of a hash of doc_id, then doc_id. No source is ordered in one task: its
    documents fall into runs, and only the lengths of the runs are summed across the source.
    """
    sizes = store(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("run"),
        ),
        "mix-sizes",
    )
    by_run = Window.partitionBy("source", "run").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    by_source = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.groupBy("source", "run")
        .agg(F.sum("size").alias("words"))
        .select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("words").over(by_source), F.lit(0)).alias("before"))
    )
    placed = sizes.withColumn("inner", F.coalesce(F.sum("size").over(by_run), F.lit(0)))
    return placed.join(offsets, placed.source.eqNullSafe(offsets.s) & (placed.run == offsets.r)).select(
        "doc_id", "source", "size", (F.col("before") + F.col("inner")).alias("start")
    )


def mix_sources(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix the documents of all sources to their targets.

    ``docs`` has doc_id, text and source; other columns are ignored. Returns

    * documents: doc_id, source, size, source_size, target, start, source_no, block_words, one per input row;
    * slots: source_no, block, shard, slot, one per block placed in the mix (its output order);
    * pieces: source_no, start, block, first, words: the words of a document in each block.

    A null or empty text has no words and is in no block; documents of equal id are kept
    apart by their places. Sources without words have target 0. Only the list of sources and
    shards x sources counts pass through the driver.
    """
    spark = docs.sparkSession
    placed = store(place_documents(docs), "mix-places")
    sizes = {r["source"]: int(r["n"]) for r in placed.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    due = targets(sizes)
    words = [min(BLOCK_WORDS, max(1, sizes[s] // 256)) for s in names]
    blocks = [-(-sizes[s] // w) for s, w in zip(names, words)]
    slots_due = np.array([due[s] * b / sizes[s] if sizes[s] else 0.0 for s, b in zip(names, blocks)])
    limit = MAX_REPEATS * np.array(blocks, np.int64)
    drawn = draw_slots(slots_due, limit, shards, seed) if names else np.zeros((shards, 0), np.int64)
    first = np.vstack([np.zeros((1, len(names)), np.int64), drawn.cumsum(0)])

    sources = spark.createDataFrame(
        [(i, s, sizes[s], due[s], w, b) for i, (s, w, b) in enumerate(zip(names, words, blocks))],
        "source_no int, s string, source_size bigint, target double, block_words bigint, n_blocks bigint",
    )
    documents = placed.join(F.broadcast(sources), placed.source.eqNullSafe(sources.s)).drop("s", "n_blocks")

    spans = spark.createDataFrame(
        [
            (i, m, int(first[m, i]), int(drawn[m, i]), blocks[i])
            for m in range(shards)
            for i in range(len(names))
            if drawn[m, i]
        ],
        "source_no int, shard int, first bigint, n bigint, n_blocks bigint",
    )
    spans = spans.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(_SPAN)))).repartition(
        int(drawn.sum()) // _TASK_SLOTS + 1, "source_no", "shard", "at"
    )

    def map_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                at = np.arange(r.at, min(r.at + _SPAN, r.n), dtype=np.int64)
                slot = r.first + at
                block = np.empty_like(slot)
                for turn in np.unique(slot // r.n_blocks):
                    own = slot // r.n_blocks == turn
                    block[own] = permute(slot[own] % r.n_blocks, r.n_blocks, seed * 1000003 + int(turn) * 8191 + r.source_no)
                yield pd.DataFrame({"source_no": r.source_no, "block": block, "shard": r.shard, "slot": at})

    slots = spans.mapInPandas(map_slots, "source_no int, block bigint, shard int, slot bigint")

    w = F.col("block_words")
    block = F.col("block") * w
    pieces = (
        documents.filter("size > 0")
        .withColumn("block", F.explode(F.expr("sequence(start div block_words, (start + size - 1) div block_words)")))
        .select(
            "source_no",
            "start",
            "block",
            (F.greatest(F.col("start"), block) - F.col("start")).alias("first"),
            (F.least(F.col("start") + F.col("size"), block + w) - F.greatest(F.col("start"), block)).alias("words"),
        )
    )
    return documents, slots, pieces


def taken_words(documents: DataFrame, slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """``documents`` with ``taken``: the words that the mix takes from each, repeats counted."""
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("uses")).hint("merge")
    taken = (
        pieces.join(uses, ["source_no", "block"])
        .groupBy("source_no", "start")
        .agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    )
    filled = documents.filter("size > 0").join(taken, ["source_no", "start"], "left")
    return filled.unionByName(documents.filter("size = 0").withColumn("taken", F.lit(None).cast("bigint"))).withColumn(
        "taken", F.coalesce("taken", F.lit(0))
    )


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """The mix as documents: each with the words taken from it, pass by pass, in ``text``.

    Words keep the white space between them; the end of a pass or gap is a line break. The
    columns of ``docs`` stay (n_chars is counted anew); documents of which nothing is taken go.
    """
    documents, slots, pieces = mix_sources(docs, shards, seed)
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("uses")).hint("merge")
    parts = (
        pieces.join(uses, ["source_no", "block"])
        .groupBy("source_no", "start")
        .agg(F.sort_array(F.collect_list(F.struct("first", "words", "uses"))).alias("_parts"))
    )
    own = {k: free_name(docs, k) for k in ("_size", "_copy", "_d", "_s", "_n", "_c", "_parts")}
    copy = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("start"))
    keyed = documents.filter("size > 0").join(parts, ["source_no", "start"]).select(
        F.col("doc_id").alias(own["_d"]), F.col("source").alias(own["_s"]), F.col("size").alias(own["_n"]),
        copy.alias(own["_c"]), F.col("_parts").alias(own["_parts"]),
    )
    rows = docs.withColumn(own["_size"], word_count(F.col("text")))
    rows = rows.withColumn(own["_copy"], F.row_number().over(Window.partitionBy("doc_id", "source", own["_size"]).orderBy("text")))
    joined = rows.join(
        keyed,
        F.col("doc_id").eqNullSafe(F.col(own["_d"])) & F.col("source").eqNullSafe(F.col(own["_s"]))
        & (F.col(own["_size"]) == F.col(own["_n"])) & (F.col(own["_copy"]) == F.col(own["_c"])),
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, parts: pd.Series) -> pd.Series:
        import re

        out = []
        for text, own in zip(texts, parts):
            at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            lines = []
            for turn in range(max(p["uses"] for p in own)):
                runs = []
                for p in own:
                    if p["uses"] > turn:
                        a, b = p["first"], p["first"] + p["words"]
                        if runs and runs[-1][1] == a:
                            runs[-1][1] = b
                        else:
                            runs.append([a, b])
                lines += [text[at[a][0] : at[b - 1][1]] for a, b in runs]
            out.append("\n".join(lines))
        return pd.Series(out, dtype=object)

    columns = [c for c in docs.columns]
    return joined.withColumn("text", cut("text", own["_parts"])).withColumn(
        "n_chars", F.length("text").cast("bigint")
    ).select(*columns)
