"""The pipeline's stages by what their operators decide, and the registered queries."""

import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from litscore.llm.common import table
from litscore.llm.jaccard import similar_groups
from litscore.llm.mixing import mix_sources, taken_words
from litscore.llm.quality import classify
from litscore.llm.suffix import remove_repeats

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


def clashing(docs):
    return docs.selectExpr("*", "'x' AS kept", "'y' AS quality_score", "'z' AS kept_id", "1 AS _size", "2 AS _parts")


def test_quality_stage(spark):
    docs = clashing(table(spark, SF, "documents"))
    good = {r.doc_id for r in classify(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    out = STAGES["quality"](spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == good


def test_jaccard_stage(spark, documents):
    docs = documents([(3, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "a b c d e f"), (None, None), (4, ""), (1, "a b c d e f")])
    assert Counter(r.doc_id for r in STAGES["jaccard"](spark, docs, SF).collect()) == Counter([1, 1, 2, None, None, 4])
    docs = table(spark, SF, "documents")
    heads = {r.component_id for r in similar_groups(docs).collect()}
    assert {r.doc_id for r in STAGES["jaccard"](spark, docs, SF).collect()} == heads


def test_suffix_stage(spark):
    docs = clashing(table(spark, SF, "documents"))
    kept = {r.doc_id: r.kept.decode("utf-8", "ignore") for r in remove_repeats(docs).collect()}
    out = STAGES["suffix"](spark, docs, SF)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {k: v for k, v in kept.items() if v}
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_mixing_stage(spark):
    docs = clashing(table(spark, SF, "documents"))
    taken = {r.doc_id: r.taken for r in taken_words(*mix_sources(docs)).collect() if r.taken}
    out = STAGES["mixing"](spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id: len(r.text.split()) for r in out.collect()} == taken


def test_run_packs_what_the_stages_keep(spark):
    docs = table(spark, SF, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    from tokenizers import Tokenizer

    from litscore.llm.tokens import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    n = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = Counter()
    for r in pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert got == n


@pytest.mark.parametrize("name", [q for q in entry.queries() if q.startswith("op")])
def test_queries_cover_their_tables(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    if name == "op12_search":  # a report of the ten best per item: items of the benchmark, ranks from 1 without gaps
        items = {r.item_id for r in table(spark, SF, "benchmark").collect()}
        ranks = {}
        for r in rows:
            ranks.setdefault(r.item_id, []).append(r["rank"])
        assert ranks and set(ranks) <= items
        assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 10 for v in ranks.values())
        return
    if name == "op13_trie":  # every conversation is a member of the root
        convs = {r.conv_id for r in table(spark, SF, "conversations").collect() if r.conv_id is not None}
        root = [r for r in rows if r.depth == 0]
        assert len(root) == 1 and root[0].n_convs == len(convs) and root[0].conv_id == min(convs)
        assert {r.conv_id for r in rows} <= convs
        return
    source = {"op2_html": "pages", "op3_neardup": "embeddings", "op8_ann": "embeddings"}.get(name, "documents")
    key = {"pages": "page_id", "embeddings": "vec_id"}.get(source, "doc_id")
    ids = {r[key] for r in table(spark, SF, source).collect()}
    if name == "op8_ann":
        ids, key = {i for i in ids if i % 50 == 0}, "query_id"
    assert {r[key] for r in rows} == ids
    if name == "op10_quality":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
