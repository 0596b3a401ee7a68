"""Decontamination and quality rules."""

import numpy as np
import pytest

from peerscope.llm import decontamination, quality_rules
from tests.llm import brute
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def items(spark, edge_rows):
    long_text = dict(edge_rows)[100]
    words = long_text.split()
    rows = [
        (1, " ".join(words[100:140])), (2, " ".join(words[3000:3013]).upper()), (3, "one two"), (4, None), (5, ""), (None, "snow ☃ man"),
        (6, "word word word"), (6, "word word word"), (7, prose(900, 30)), (8, " ".join(words[5990:])), (9, "x y"),
    ]
    return rows, spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("block_windows", [200_000, 5])
def test_decontamination(edge_docs, edge_rows, items, block_windows):
    rows, table = items
    found = decontamination.decontaminate(edge_docs, table, block_windows=block_windows).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in found), key=str)
    assert got == brute.contamination(edge_rows, rows)
    assert all(r["row"]["row"] == "x" for r in found)


def test_decontamination_of_empty_tables(edge_docs, no_docs, items):
    assert decontamination.decontaminate(no_docs, items[1]).count() == 0
    rows = decontamination.decontaminate(edge_docs, items[1].limit(0)).collect()
    assert rows and not any(r["n_hit"] or r["contaminated"] or r["items"] for r in rows)


def test_quality_counts(edge_docs, edge_rows):
    rows = quality_rules.judge(edge_docs, quality_rules.references(edge_docs)).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == sorted((i or 0, *brute.quality(t)) for i, t in edge_rows)
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_lines_and_symbols(spark):
    text = "a b\n\na b\na b \n \n#*$%&|<>\n" + "x y z x y z"
    docs = spark.createDataFrame([(1, text, "en")], "doc_id int, text string, lang string")
    row = quality_rules.judge(docs, quality_rules.references(docs)).first()
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == brute.quality(text)


def test_quality_without_languages(no_docs, edge_docs):
    assert quality_rules.judge(no_docs, quality_rules.references(no_docs)).count() == 0
    rows = quality_rules.judge(edge_docs, quality_rules.references(no_docs)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)


def test_divergent_texts_are_dropped(spark):
    rows = [(k, prose(k, 200), "en") for k in range(60)] + [(100, "| $$$ ## | " * 60 + prose(3, 60).upper(), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, quality_rules.references(docs)).collect()}
    assert not kept.pop(100) and all(kept.values())


def test_js_distance():
    q = np.array([4.0, 4.0, 0.0])
    got = quality_rules.js_distance(np.array([[1, 1, 0], [0, 0, 5], [0, 0, 0], [1, 0, 0]]), q)
    assert got[:3] == pytest.approx([0, 1, 0]) and got[3] == pytest.approx(np.sqrt(0.75 * np.log2(4 / 3) + 0.25 - 0.0), abs=0.35)
