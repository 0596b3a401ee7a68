"""Word hashes, and the operators that rest on them, on words that collide in polynomials modulo 2**64."""

import numpy as np
import pytest

from peerscope.llm import decontamination, hmm, lz_dedup, ngram_join, quality_rules, repeats
from peerscope.llm.hashing import LONG_SPAN, Words, byte_hashes
from tests.llm.conftest import prose


def thue_morse(bits, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(1 << bits))


WORDS = [thue_morse(bits, flip) for bits in (10, 11, 13) for flip in (0, 1)]


def test_words_that_collide_in_polynomials():
    text = np.frombuffer(" ".join(WORDS).encode(), np.uint8)
    assert len(set(Words(text, np.array([0, len(text)])).hashes.tolist())) == len(WORDS)


def test_byte_hashes_tell_spans_apart():
    random = np.random.default_rng(2)
    data = random.integers(0, 3, 40_000).astype(np.uint8)
    start = random.integers(0, 20_000, 20_000)
    end = start + random.integers(0, 12, 20_000)
    end[:50] = start[:50] + LONG_SPAN - 3 + np.arange(50) % 6
    hashes = byte_hashes(data, start, end)
    known = {}
    for s, e, h in zip(start.tolist(), end.tolist(), hashes.tolist(), strict=True):
        assert known.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(known.values())) == len(known)


@pytest.fixture(scope="module")
def twins(spark):
    shared = prose(1, 25)
    rows = [(1, f"{WORDS[0]} {shared}"), (2, f"{WORDS[1]} {shared}"), (3, f"{WORDS[2]} x"), (4, f"{WORDS[3]} x")]
    return spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id bigint, text string, lang string, source string")


def test_substring_dedup(twins):
    rows = {r["doc_id"]: r for r in lz_dedup.factor_documents(twins).collect()}
    assert rows[2]["n_words"] == 26 and rows[2]["n_removed"] == 25


def test_ngram_join(twins):
    rows = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(twins).collect()}
    assert rows[3] == 3 and rows[4] == 4


def test_decontamination(spark, twins):
    items = spark.createDataFrame([(1, WORDS[4]), (2, WORDS[1])], "item_id bigint, text string")
    rows = {r["doc_id"]: r["n_hit"] for r in decontamination.decontaminate(twins, items).collect()}
    assert rows == {1: 0, 2: 1, 3: 0, 4: 0}


def test_quality_rules(spark):
    text = f"{WORDS[0]} y z\n{WORDS[1]} y z"
    docs = spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string")
    row = quality_rules.judge(docs, quality_rules.references(docs)).first()
    assert (row["n_repeat_words"], row["n_dup_lines"]) == (0, 0)


def test_language_model(twins):
    row = {r["doc_id"]: r for r in hmm.fit_and_score(twins, twins.filter("doc_id != 2")).collect()}[2]
    assert row["n_known"] == row["n_tokens"] - 1


def test_runs_must_fit_their_place(twins):
    with pytest.raises(ValueError, match="more than a gram"):
        repeats.find_runs(twins, lz_dedup.word_units, 200, 6)
