"""The conversation trie by a splitter skeleton against a brute-force trie."""

import hashlib
import random
import zlib

from litscore.llm.trie import conversation_trie, skeleton, walk

SCHEMA = "conv_id bigint, turn bigint, role string, text string, extra string"


def brute(rows):
    """Nodes of the rebuilt conversations, from the rows by plain Python."""
    turns = {}
    for c, t, role, text, _ in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t if t is not None else 0, role or "", text or ""))
    ordered = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in ordered:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = ordered.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + ordered[c][h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = {}
    for prefix, members in nodes.items():
        d = len(prefix)
        kids = [p for p in nodes if len(p) == d + 1 and p[:d] == prefix]
        sub = [p for p in nodes if p[:d] == prefix]
        leaves = sum(1 for p in sub if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes))
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in sub)
        ends = sorted(c for c in members if len(rebuilt[c]) == d)
        out[(min(members), d)] = (
            min(nodes[prefix[:-1]]) if d else None, len(members), len(kids), leaves, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def got(spark, rows, partitions):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("extra", "n_convs")
    found = conversation_trie(df, partitions).collect()
    assert len(found) == len({(r.conv_id, r.depth) for r in found})
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}


def table(seed=1, n=300):
    rng = random.Random(seed)
    texts = ["hi", "hello", "how are you?", "", None, "fine", "é日", "the same words", "x" * 300]
    rows = []
    for c in rng.sample(range(0, 1200), n):
        k = rng.choice([0, 1, 2, 3, 4, 6, 9])
        for t in range(k):
            rows.append((c, rng.choice([t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(texts), "x"))
    for c in range(2000, 2000 + 60):  # many copies of one conversation
        rows += [(c, 0, "user", "hot first turn", None), (c, 1, "assistant", "hot", None)]
    rows += [(None, 1, "user", "no id", None), (3000, None, None, None, None), (3000, None, None, None, None)]
    return rows


def test_equals_brute_force_on_one_shard(spark):
    rows = table()
    assert got(spark, rows, 1) == brute(rows)


def test_equals_brute_force_on_many_shards(spark):
    rows = table(2)
    want = brute(rows)
    for partitions in (3, 17, 64):
        assert got(spark, rows, partitions) == want


def test_conversation_without_turns_of_its_own(spark):
    rows = [(100, 0, "user", "a", None), (100, 1, "user", "b", None), (105, 5, "user", "c", None), (7, None, None, None, None)]
    assert got(spark, rows, 4) == brute(rows)


def test_empty_table(spark):
    assert got(spark, [], 4) == {}


def test_skeleton_holds_shared_prefixes():
    a, b, c = (1, 1), (2, 2), (3, 3)
    trie = skeleton([(1, [a, b], [a, c]), (0, [a], [a, b]), (2, [b], [b])])
    assert set(trie) == {(0, a), (1, b)}
    rows = list(walk(iter([{"conv_id": 5, "keys": [a, b], "chars": [1, 1]}]), trie))
    assert {r["kind"] for r in rows} == {"part", "end"}
