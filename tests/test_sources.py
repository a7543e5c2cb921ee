import pytest
from pyspark.sql import functions as F

from litscore import session
from litscore.operators.filters import CREATED, filter_library_since
from litscore.operators.vectors import HashTfIdf
from litscore.plans.library import build_library
from litscore.schema import MESSAGE
from litscore.sources.digests import compact_digest, read_digest
from litscore.sources import read_library, read_library_csv, read_messages, write_digest

EXPORT = '''title,abstract,doi,arxiv,url,"created (Read-Only)"
"One, ""quoted""","line one
line two",10.1/a,,,2022-01-01
Two,,,2401.1,,2021-12-31
,"no title",,,https://x.example,2023-01-01
'''


@pytest.fixture
def export(tmp_path):
    (tmp_path / "a.csv").write_text(EXPORT)
    return str(tmp_path / "a.csv")


def test_csv(spark, export):
    df = read_library_csv(spark, export)
    assert {t for _, t in df.dtypes} == {"string"}
    rows = df.orderBy(CREATED).collect()
    assert [r["title"] for r in rows] == ["Two", 'One, "quoted"', None]
    assert (rows[0]["abstract"], rows[0]["doi"], rows[1]["abstract"]) == (None, None, "line one\nline two")


def test_since(spark, export):
    df = read_library_csv(spark, export)
    assert filter_library_since(df, "2022-01-01").count() == 2
    assert filter_library_since(df, "2022-01-01", inclusive=False).count() == 1


def test_build_library(spark, tmp_path):
    rows = "".join(f'"Title {i % 30}","About {i % 30} things",2022-01-0{i % 3 + 1}\n' for i in range(60))
    (tmp_path / "a.csv").write_text(f'title,abstract,"{CREATED}"\n' + rows + ',"untitled",2022-01-03\n')
    path = str(tmp_path / "library")
    report = build_library(spark, str(tmp_path / "a.csv"), path, HashTfIdf())
    assert report == (61, 1)
    stored = read_library(spark, path)
    assert stored.count() == 60 and stored.select("article_id").distinct().count() == 60
    assert {"input", "embedding", "cv_fold", "cv_distance"} <= set(stored.columns)
    sizes = [r["count"] for r in stored.groupBy("cv_fold").count().collect()]
    assert sizes == [12] * 5
    assert stored.filter(F.col("cv_distance").isNull()).count() == 0
    assert build_library(spark, str(tmp_path / "a.csv"), path, since="2022-01-02") == (41, 1)


def test_messages(spark, tmp_path):
    row = ("m", 1, "()", "a@x.example", "b@x.example", "s", None, "<p>", None)
    spark.createDataFrame([row], MESSAGE).write.parquet(str(tmp_path / "m"))
    assert read_messages(spark, str(tmp_path / "m")).first()["uid"] == 1
    assert read_messages(spark, str(tmp_path / "m"), streaming=True).isStreaming


def test_digest_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.range(10)
    write_digest(df, path, "a")
    write_digest(df.filter("id < 3"), path, "b")
    write_digest(df.filter("id < 5"), path, "b")
    counts = read_digest(spark, path).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in counts} == {"a": 10, "b": 5}


def test_digest_publishes_whole_batches(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.range(10)
    write_digest(df, path, "a")
    write_digest(df.filter("id < 3"), path, "007")
    # a write that fails before it is published leaves the old rows
    df.filter("id < 1").write.parquet(f"{path}/_batches/part=ulost")
    assert {r["batch"]: r["count"] for r in read_digest(spark, path).groupBy("batch").count().collect()} == {"a": 10, "007": 3}
    write_digest(df.filter("id < 0"), path, "a")  # emptied
    assert {r["batch"] for r in read_digest(spark, path).collect()} == {"007"}
    assert compact_digest(spark, path) >= 1
    assert read_digest(spark, path).count() == 3
    assert read_digest(spark, str(tmp_path / "none"), "id BIGINT").count() == 0


def test_shared_folder(spark):
    folder = session.shared_dir(spark)
    assert session.shared_dir(spark) == folder
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_spread(spark):
    assert session.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8
    assert session.spread(spark.range(0, 10, 1, 20)).rdd.getNumPartitions() == 20
