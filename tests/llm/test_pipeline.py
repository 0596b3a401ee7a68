"""The pipeline: each stage against brute force on what it is given."""

import pytest

import corpus_pipeline
from peerscope.llm import lz_dedup, mixing
from tests.llm import brute
from tests.llm.conftest import prose

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, edge_docs, edge_rows):
    """A small data folder around the odd rows: labels mark a few rude texts."""
    path = str(tmp_path_factory.mktemp("tables"))
    words = dict(edge_rows)[100].split()
    rude = [(1000 + k, prose(1000 + k, 60) + " grobnik schurkel" * (k % 4 == 0), "en", "s0", 1, "x", 0.0, [1]) for k in range(200)]
    spark.createDataFrame(rude, edge_docs.schema).unionByName(edge_docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 4 == 0)) for r in rude if r[0] % 3], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words[500:1200])), (2, prose(600, 50))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return sorted((r["doc_id"] is not None, r["doc_id"]) for r in df.select("doc_id").collect())


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "decontamination", "mixing"]


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = STAGES["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert not left & {k for k in range(1000, 1200) if k % 4 == 0}
    assert {k for k in range(1000, 1200) if k % 4} <= left


def test_one_of_each_group_stays(spark, edge_docs, edge_rows, folder):
    kept = STAGES["ngram_join"](spark, edge_docs, folder)
    assert kept.columns == edge_docs.columns
    expected = sorted({doc for doc, _, lowest in brute.groups(edge_rows) if doc == lowest})
    assert sorted(brute.ident(r["doc_id"]) for r in kept.collect()) == expected


def test_repeated_passages_go(spark, edge_docs, edge_rows, folder):
    kept = STAGES["substring_dedup"](spark, edge_docs, folder)
    assert kept.columns == edge_docs.columns
    expected, texts = brute.repeated_words(edge_rows, lz_dedup.WINDOW), dict(brute.documents(edge_rows))
    for r in kept.collect():
        doc = brute.ident(r["doc_id"])
        if expected[doc][1]:
            assert brute.sha(r["text"].encode()) == expected[doc][2] and r["n_chars"] == len(r["text"])
        else:
            assert (r["text"] or "") == texts[doc]


def test_contaminated_documents_go(spark, edge_docs, edge_rows, folder):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = STAGES["decontamination"](spark, edge_docs, folder)
    clean = [r[0] for r in brute.contamination(edge_rows, items) if not r[4]]
    assert len(clean) < len(edge_rows)
    assert ids(kept) == sorted((c is not None, c) for c in clean)


def test_mixture(spark, edge_docs, folder):
    drawn = STAGES["mixing"](spark, edge_docs, folder)
    assert drawn.columns == [*edge_docs.columns, "probability"]
    assert ids(drawn) == ids(mixing.mix(edge_docs).filter("kept"))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert out.columns == [*docs.columns, "probability"]
    assert 0 < out.count() < docs.count()


def test_run_on_an_empty_table(spark, folder, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
