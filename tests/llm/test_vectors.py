"""Vector operators against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from litscore.llm import ann
from litscore.llm.ann import Projections, nearest
from litscore.llm.components import components, forest_of
from litscore.llm.neardup import learn_rotations, near_duplicates

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(n=500, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dims))
    rows = []
    for i in range(n):
        own = centres[i % len(centres)] + rng.standard_normal(dims) * rng.choice([0.0, 0.05, 0.2, 0.3, 2.0])
        rows.append((i, (own * rng.choice([0.5, 1, 3])).astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(n + k, list(rows[k][1]), rows[k][2]) for k in range(30)]
    odd = [None, [], [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0, 2.0]]
    rows += [(2 * n + k, v, 1) for k, v in enumerate(odd)]
    rows += [(3 * n, rows[0][1], None), (None, rows[0][1], rows[0][2]), (3 * n + 1, [1.0, 2.1], 1)]
    return rows


def unit(v):
    if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
        return None
    x = np.array(v, float)
    return x / np.linalg.norm(x)


@pytest.mark.parametrize("bucket_rows", [512, 16])
def test_near_duplicates_equal_brute_force(spark, bucket_rows):
    rows = vectors()
    units = [unit(v) if i is not None and label is not None else None for i, v, label in rows]
    links, group = Counter(), {r[0]: r[0] for r in rows if r[0] is not None}
    edges = [
        (rows[i][0], rows[j][0])
        for i in range(len(rows)) for j in range(i)
        if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93
    ]
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    for _ in range(30):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(1) for k in ("rep", "raw", "code", "keys", "links")})
    got = near_duplicates(df, bucket_rows=bucket_rows).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter((i, links[i], group.get(i)) for i, _, _ in rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


@pytest.mark.parametrize(("shift", "share"), [(1.3, 1.0), (2.0, 1.0), (1.7, 0.33)])
def test_near_duplicates_of_vectors_that_share_a_direction(spark, shift, share):
    rng, n, dims = np.random.default_rng(8), 1500, 64
    unit_rows = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit_rows(rng.standard_normal((n, dims)))
    x[:, 0] += shift * (rng.random(n) < share)
    x = unit_rows(x)
    aside = rng.standard_normal((n, dims))
    aside = unit_rows(aside - (aside * x).sum(1, keepdims=True) * x)
    cosine = np.resize([0.931, 0.94, 0.95], n)[:, None]
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * aside])
    near = np.triu(x @ x.T >= 0.93, 1)
    expected = near.sum(0) + near.sum(1)
    got = near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")).collect()
    links = np.zeros(2 * n, int)
    links[[r.vec_id for r in got]] = [r.n_links for r in got]
    print("recall", links.sum() / expected.sum(), "norm of the mean", np.linalg.norm(x.mean(0)), "links", int(expected.sum()))
    assert (links <= expected).all() and links.sum() >= 0.999 * expected.sum()


def test_rotations_are_orthogonal():
    mean, turns = learn_rotations(np.random.default_rng(1).standard_normal((300, 12)), 30)
    assert turns.shape == (12, 30) and np.allclose(turns[:, :12].T @ turns[:, :12], np.eye(12)) and len(mean) == 12


def test_nearest_equals_brute_force(spark):
    rows = [r for r in vectors(900, 24, 5) if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(1) for k in ("asks", "dims", "block", "rank", "score")})
    got, expected = {}, {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    units = {i: unit(v) for i, v, _ in rows}
    for q, x in units.items():
        if q % 50 or x is None:
            continue
        near = sorted((-float(x @ y), i) for i, y in units.items() if i != q and y is not None and len(y) == len(x))[:5]
        expected[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert set(got) == set(expected)
    hits = 0
    for q, own in expected.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(own) + 1))
        assert all(abs(s - float(units[q] @ units[i])) < 1e-12 for _, i, s in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits += len({i for _, i, _ in mine} & {i for _, i, _ in own})
    assert hits >= 0.95 * sum(map(len, expected.values()))


def brute_nearest(rows, k=5):
    units = {i: unit(v) for i, v, _ in rows}
    near = {q: sorted((-float(x @ y), i) for i, y in units.items() if i != q)[:k] for q, x in units.items() if q % 50 == 0}
    return {q: [i for _, i in own] for q, own in near.items()}


@pytest.mark.parametrize("spreads", [0.05, 3.0])
def test_nearest_over_several_blocks_and_groups(spark, monkeypatch, spreads):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 5)
    visits = []
    monkeypatch.setattr(ann, "_visits", lambda *given, real=ann._visits: visits.append(real(*given)) or visits[-1])
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 24)) * 2
    rows = [(i, (centres[i % 6] + spreads * rng.standard_normal(24)).tolist(), 1) for i in range(1200)]
    rows += [(1200 + i, rows[7][1], 1) for i in range(150)]  # copies that fill blocks of their own
    got, expected = {}, brute_nearest(rows)
    for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == expected.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(own)) for q, own in expected.items()) >= 0.95 * 5 * len(expected)
    visited = sum(len(r.blocks) for r in visits[0].collect())
    if spreads < 1:  # blocks of other directions are left out
        assert 0 < visited < 0.5 * len(expected) * (len(rows) / 60 - 1)


def test_a_bound_from_another_block_opens_the_windows_once(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, opened = Projections(x), []
    monkeypatch.setattr(Projections, "windows", lambda *given, real=Projections.windows: opened.append(1) or real(*given))
    exact = np.sort(x[:20] @ x.T, 1)[:, ::-1][:, 1:6]
    within = np.sqrt(2 - 2 * exact[:, 4])
    hits = 0
    for own, (rows, scores) in zip(exact, index.search(x[:20], 5, np.arange(20), within)):
        hits += (np.sort(scores)[::-1][:5] >= own - 1e-12).sum()
    assert len(opened) == 20 and hits >= 95


def test_search_reaches_all_if_asked_for_more_than_there_are():
    x = np.random.default_rng(3).standard_normal((7, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, scores = next(Projections(x).search(x[:1], 50, np.array([0])))
    assert sorted(rows.tolist()) == [1, 2, 3, 4, 5, 6] and np.allclose(scores, x[rows] @ x[0])


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(300)]
    label = {v: v for e in edges for v in e}
    for _ in range(80):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    alone = {a for a, b in edges if a == b} - {v for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in label.items() if k not in alone}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    own = np.array([e for e in edges if max(e) < 400])
    assert {i: int(c) for i, c in enumerate(forest_of(400, own[:, 0], own[:, 1])) if i in got} == {i: got[i] for i in got if i < 400}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(none).collect() == [] and nearest(none, F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("times", [2, 3, 6])
def test_repeated_rows_are_one_vector(spark, times):
    rows = [r for r in vectors(300, 16, 8) if r[0] is not None and r[2] is not None]
    once = spark.createDataFrame(rows, SCHEMA)
    many = spark.createDataFrame(rows * times, SCHEMA)
    single = Counter((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(once).collect())
    repeated = Counter((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(many).collect())
    assert repeated == Counter({k: v * times for k, v in single.items()})
    asked = F.col("vec_id") % 50 == 0
    alone = sorted(tuple(r) for r in nearest(once, asked).collect())
    assert sorted(tuple(r) for r in nearest(many, asked).collect()) == alone
    assert all(q != v for q, _, v, _ in alone) and len(alone) == 5 * len({q for q, _, _, _ in alone})


def test_own_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.02], 1), (50, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (3, [0.5, 0.5], 1)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 50).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3]
