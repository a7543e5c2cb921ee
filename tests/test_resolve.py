import pytest
from pyspark.sql import functions as F

from litscore.operators import joins, resolve
from litscore.plans.library import resolve_library
from litscore.schema import ARTICLE_FIELDS


def articles(spark, *rows, extra=()):
    fields = [*ARTICLE_FIELDS, *extra]
    schema = ", ".join(f"{f} {'INT' if f == 'year' else 'STRING'}" for f in fields)
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


def pages(spark, *rows):
    """Pages that hold all that is needed but for what a row sets otherwise."""
    needed = {"publisher_url": "p", "abstract": "x", "journal": "J", "year": 2000, "authors": "A"}
    return articles(spark, *({**needed, **row} for row in rows), extra=("url", "publisher"))


def wanted(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id STRING")


def stages(df):
    return {r["id"]: (r["stage"], r["title"]) for r in df.collect()}


@pytest.fixture
def sources(spark):
    return {
        "s2": articles(
            spark,
            {"doi": "10.1038/a", "title": "s2 a", "abstract": "x"},
            {"doi": "10.1038/b", "title": "s2 b"},
            {"doi": "10.9/e", "title": "second", "abstract": "x", "pmid": "2"},
            {"doi": "10.9/e", "title": "first", "abstract": "x", "pmid": "1"},
            {"semantic_scholar": "hex", "title": "s2 hex"},
        ),
        "crossref": articles(
            spark,
            {"doi": "10.1038/A", "title": "crossref a", "abstract": "x"},
            {"doi": "10.1038/b", "abstract": "x"},
            {"doi": "10.9/F", "title": "crossref f", "abstract": ""},
        ),
        "pages": pages(
            spark,
            {"doi": "10.1038/b", "title": "nature b", "publisher": "nature", "url": "n"},
            {"doi": "10.9/g", "title": "nature g", "publisher": "nature", "url": "m"},
            {"doi": "10.1038/bare", "title": "no abstract", "abstract": None, "publisher": "nature", "url": "k"},
            {"title": "forum", "publisher": "openreview", "url": "https://openreview.net/forum?id=1"},
            {"doi": "10.1101/1", "title": "bio", "publisher": "biorxiv", "url": "https://www.biorxiv.org/content/early/1"},
        ),
        "arxiv": articles(
            spark, {"doi": "10.48550/arXiv.2401.1", "arxiv": "2401.1", "title": "arxiv 1"}
        ),
        "elsevier": articles(
            spark, {"doi": "10.1016/d", "title": "elsevier d", "publisher_url": "https://s.example/pii/S1"}
        ),
        "doi_redirect": spark.createDataFrame(
            [("10.1016/d", "https://l.example/pii/S1"), ("10.9/h", "https://l.example/pii/S1")],
            "doi STRING, url STRING",
        ),
    }


ASKED = [
    "10.1038/a", "10.1038/b", "10.48550/arxiv.2401.1v3", "10.1016/d", "10.9/e", "10.9/f", "10.9/g",
    "10.9/h", "10.9/e",
]


def test_waterfall(spark, sources):
    found = resolve.resolve_waterfall(wanted(spark, *ASKED), sources)
    assert stages(found) == {
        "10.1038/a": ("s2", "s2 a"),
        "10.1038/b": ("nature", "nature b"),
        "10.48550/arxiv.2401.1v3": ("arxiv", "arxiv 1"),
        "10.1016/d": ("elsevier", "elsevier d"),
        "10.9/e": ("s2", "first"),
        "10.9/f": ("crossref", "crossref f"),
    }
    assert found.count() == 6


def test_exact_keys(spark, sources):
    ids = wanted(spark, "10.1038/a", "10.9/f", "10.9/F", "10.48550/arxiv.2401.1", "10.1016/d")
    assert stages(resolve.resolve_waterfall(ids, sources, "exact")) == {
        "10.1038/a": ("s2", "s2 a"),
        "10.9/F": ("crossref", "crossref f"),
        "10.1016/d": ("elsevier", "elsevier d"),
    }
    with pytest.raises(ValueError):
        resolve.resolve_waterfall(ids, sources, "other")


def test_nature_stages(spark, sources):
    ids = wanted(spark, "10.1038/b", "10.9/g", "10.1016/d")
    found = resolve.resolve_waterfall(ids, sources, stages=resolve.NATURE_STAGES)
    assert stages(found) == {"10.1038/b": ("nature", "nature b"), "10.9/g": ("nature", "nature g")}


def test_many_wanted_ids_give_the_same(spark, sources, monkeypatch):
    expected = stages(resolve.resolve_waterfall(wanted(spark, *ASKED), sources))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    assert stages(resolve.resolve_waterfall(wanted(spark, *ASKED), sources)) == expected
    assert not joins.fits_broadcast(wanted(spark, *ASKED))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 10)
    assert not joins.fits_broadcast(wanted(spark, *ASKED))


def test_absent_sources(spark, sources):
    ids = wanted(spark, "10.1038/a")
    assert resolve.resolve_waterfall(ids, {}).count() == 0
    only = {"elsevier": sources["elsevier"]}
    assert resolve.resolve_waterfall(ids, only).columns == ["id", "stage", "rank", *ARTICLE_FIELDS]


def test_found_and_missing_are_all(spark, sources):
    ids = wanted(spark, *ASKED)
    found = resolve.resolve_waterfall(ids, sources)
    missing = {r["id"] for r in resolve.missing_ids(ids, found).collect()}
    assert missing == {"10.9/g", "10.9/h"}
    report = {r["stage"]: (r["attempted"], r["loaded"]) for r in resolve.resolution_report(ids, found).collect()}
    assert report == {
        "s2": (8, 2),
        "crossref": (6, 1),
        "nature": (1, 1),
        "arxiv": (1, 1),
        "elsevier": (1, 1),
        "total": (8, 6),
    }


ROWS = [
    (1, "10.9/e", "2401.1", "https://arxiv.org/abs/2401.1"),
    (2, None, "2401.1v2", "https://openreview.net/forum?id=1"),
    (3, None, None, "https://arxiv.org/abs/2401.1v9"),
    (4, None, None, "http://arxiv.org/abs/2401.1"),
    (5, None, "2401.9", None),
    (6, None, None, "https://arxiv.org/abs/math/0001001"),
    (7, None, None, None),
]


def library(spark):
    return spark.createDataFrame(ROWS, "row_id BIGINT, doi STRING, arxiv STRING, url STRING")


def test_without_doi(spark, sources):
    found = resolve.resolve_without_doi(library(spark), sources).collect()
    assert sorted((r["row_id"], r["route"], r["title"]) for r in found) == [
        (2, "arxiv_id", "arxiv 1"),
        (2, "openreview_url", "forum"),
        (3, "arxiv_url", "arxiv 1"),
    ]
    assert [r["row_id"] for r in resolve.leftover_urls(library(spark)).collect()] == [4]


def test_resolve_library(spark, sources):
    found = resolve_library(library(spark), sources)
    assert sorted((r["id"], r["stage"]) for r in found.articles.collect()) == [
        ("10.9/e", "s2"),
        ("2", "arxiv_id"),
        ("2", "openreview_url"),
        ("3", "arxiv_url"),
    ]
    assert found.missing.count() == 0 and found.leftover.count() == 1


def test_by_type(spark, sources):
    ids = spark.createDataFrame(
        [
            ("s2", "hex"),
            ("arxiv", "2401.1v2"),
            ("nature_doi", "10.1038/b"),
            ("nature_doi", "10.1038/zz"),
            ("biorxiv_url", "http://www.biorxiv.org/content/early/1"),
            ("science_url", "https://www.biorxiv.org/content/early/1"),
            ("pmid", "1"),
            ("s2", "hex"),
        ],
        "id_type STRING, id STRING",
    )
    found = resolve.resolve_by_type(ids, sources)
    assert sorted((r["id_type"], r["stage"], r["title"]) for r in found.collect()) == [
        ("arxiv", "arxiv", "arxiv 1"),
        ("biorxiv_url", "biorxiv", "bio"),
        ("nature_doi", "nature", "nature b"),
        ("s2", "s2", "s2 hex"),
    ]
    assert {tuple(r) for r in resolve.unresolved_ids(ids, found).collect()} == {
        ("nature_doi", "10.1038/zz"),
        ("pmid", "1"),
        ("science_url", "https://www.biorxiv.org/content/early/1"),
    }


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys(spark, how):
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    left = spark.range(20_000).select(key.alias("k"), "id")
    right = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    one, two = joins.join_unique(left, right, ["k"], how, hot_rows=1000), left.join(right, "k", how)
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_hot_records_are_thinned_before_the_shuffle(spark):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)
    first = joins.first_rows(spark.range(1000).select(key.alias("k"), "id"), ["k"], ["id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    expected = {}
    for i in range(1000):
        expected.setdefault(0 if i % 3 == 0 else i % 7, i)
    assert dict(tuple(r) for r in first.collect()) == expected


def test_pages_without_required_fields_give_no_article(spark, sources):
    ids = wanted(spark, "10.1038/bare", "10.1038/b")
    found = resolve.resolve_waterfall(ids, sources)
    assert {r["id"] for r in found.collect()} == {"10.1038/b"}
    assert [r["id"] for r in resolve.missing_ids(ids, found).collect()] == ["10.1038/bare"]


def test_pages_are_scanned_once(spark, sources, tmp_path):
    sources["pages"].write.parquet(str(tmp_path / "landed-pages"))
    stored = spark.read.parquet(str(tmp_path / "landed-pages"))
    ids = spark.createDataFrame([("nature_doi", "10.1038/b"), ("science_url", "u")], "id_type STRING, id STRING")
    found = resolve.resolve_by_type(ids, {**sources, "pages": stored})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_many_keys_drop_records_before_the_shuffle(spark, monkeypatch):
    """Bits of the wanted keys keep every record of such a key and few others."""
    on = ["id_type", "key"]
    name = (F.col("id") % 3).cast("string").alias("id_type"), F.col("id").cast("string").alias("key")
    records = spark.range(20_000).select(*name, F.col("id").alias("n"))
    odd = spark.createDataFrame([(None, "5", -1), ("1", None, -2)], "id_type STRING, key STRING, n BIGINT")
    keys = spark.range(0, 20_000, 50).select(*name).unionByName(odd.select(*on))
    likely = joins._likely_wanted(records.unionByName(odd), keys, on)
    assert 400 <= likely.count() < 800
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    found = joins.only_wanted(records.unionByName(odd), keys, on)
    assert sorted(r.n for r in found.collect()) == list(range(0, 20_000, 50))
    assert "getbit" in found._jdf.queryExecution().optimizedPlan().toString()
    assert joins.only_wanted(records, keys.filter("key = 'no'"), on).count() == 0
