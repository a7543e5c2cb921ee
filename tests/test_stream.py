from litscore.sources.digests import read_digest
import pytest
from pyspark.sql import functions as F

from litscore.operators.extract import SENDERS
from litscore.operators.filters import encoder_input
from litscore.operators.vectors import HashTfIdf
from litscore.plans.alerts import score_messages
from litscore.schema import ARTICLE_FIELDS, MESSAGE
from litscore.streaming import pending_messages, redrive_unhandled, score_alert_stream

FROM = {route: address for address, route in SENDERS.items()}
TITLES = [f"paper {i} on {'graphs' if i % 2 else 'cells'} number {i % 5}" for i in range(20)]


def articles(spark, *rows):
    schema = ", ".join(f"{f} {'INT' if f == 'year' else 'STRING'}" for f in ARTICLE_FIELDS)
    return spark.createDataFrame([tuple(r.get(f) for f in ARTICLE_FIELDS) for r in rows], schema)


@pytest.fixture
def world(spark, tmp_path):
    texts = spark.createDataFrame([(i, t, None) for i, t in enumerate(TITLES)], "article_id INT, title STRING, abstract STRING")
    encoder = HashTfIdf().fit(encoder_input(texts))
    library = encoder.transform(encoder_input(texts))
    sources = {
        "arxiv": articles(
            spark,
            *({"arxiv": f"2401.{i}", "doi": f"10.48550/arXiv.2401.{i}", "title": TITLES[i], "journal": "arXiv"} for i in range(5)),
            {"arxiv": "2401.7"},
        )
    }
    queue = str(tmp_path / "queue")

    def land(*messages):
        rows = [(m, 1, "()", FROM.get(r, r), "b", "s", None, None, t) for m, r, t in messages]
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(queue)

    land(
        ("one", "arxiv", "arXiv:2401.0\narXiv:2401.1\narXiv:2401.1\narXiv:2401.7"),
        ("two", "arxiv", "arXiv:2401.1"),
        ("no ids", "arxiv", "nothing"),
        ("no articles", "arxiv", "arXiv:9999.1"),
        ("no titles", "arxiv", "arXiv:2401.7"),
        ("unknown", "x@example.org", "arXiv:2401.1"),
    )
    return encoder, library, sources, queue, land


REASONS = {
    "no ids": "no_ids",
    "no articles": "no_articles",
    "no titles": "no_titles",
    "unknown": "unknown_sender",
}


def scored_rows(df):
    return sorted((r["message_id"], r["id"], round(r["distance"], 9)) for r in df.collect())


def reasons(df):
    return {r["message_id"]: r["reason"] for r in df.collect()}


def test_every_message_is_in_one_part(spark, world):
    encoder, library, sources, queue, _ = world
    found = score_messages(spark.read.parquet(queue), library, sources, encoder)
    assert [r[:2] for r in scored_rows(found.scored)] == [("one", "2401.0"), ("one", "2401.1"), ("two", "2401.1")]
    assert reasons(found.unhandled) == REASONS
    assert "embedding" not in found.scored.columns


def test_stream_equals_batch_and_keeps_its_place(spark, world, tmp_path):
    encoder, library, sources, queue, land = world
    out = str(tmp_path / "out")

    def run():
        query = score_alert_stream(
            spark, queue, library, sources, out, str(tmp_path / "checkpoint"), encoder, 0.5
        )
        query.awaitTermination()
        return read_digest(spark, f"{out}/scored")

    batch = score_messages(spark.read.parquet(queue), library, sources, encoder)
    first = scored_rows(run())
    assert first == scored_rows(batch.scored)
    assert reasons(read_digest(spark, f"{out}/unhandled")) == REASONS
    assert scored_rows(run()) == first

    land(("three", "arxiv", "arXiv:2401.2"))
    again = run()
    assert [r[0] for r in scored_rows(again)] == ["one", "one", "three", "two"]
    assert again.select("batch").distinct().count() == 2
    html = read_digest(spark, f"{out}/html")
    assert {r["message_id"] for r in html.collect()} == {"one", "two", "three"}
    summary = {r["message_id"]: r["total"] for r in read_digest(spark, f"{out}/summary").collect()}
    assert summary == {"one": 2, "two": 1, "three": 1}

    assert {r["message_id"] for r in pending_messages(spark, out).collect()} == set(REASONS)
    more = articles(spark, {"arxiv": "9999.1", "title": TITLES[9]})
    landed = {"arxiv": sources["arxiv"].unionByName(more)}
    for _ in range(2):
        redrive_unhandled(spark, queue, library, landed, out, "1", encoder, 0.5)
        pending = {r["message_id"] for r in pending_messages(spark, out).collect()}
        assert pending == set(REASONS) - {"no articles"}
    assert read_digest(spark, f"{out}/scored").filter(F.col("message_id") == "no articles").count() == 1


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from litscore.session import materialise, scratch_path, scratch_scope

    with scratch_scope(spark):
        inner = scratch_path(spark, "a")
        stored = materialise(spark.range(3), "b")
        path = stored.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
        with scratch_scope(spark):
            nested = materialise(spark.range(2), "c").inputFiles()[0].removeprefix("file://")
        assert not os.path.exists(nested) and os.path.exists(path)
    assert not os.path.exists(path) and not os.path.exists(inner)


def test_library_code_demands_a_shared_folder(spark, monkeypatch):
    from litscore import session

    monkeypatch.setattr(session, "_named_dir", lambda _: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_path(spark, "x")
