"""Trained operators: held-out accuracy, exact likelihoods and odd inputs."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerscope.llm import compression_quality, hmm, language_id, toxicity
from tests.llm import brute
from tests.llm.conftest import prose

LANGUAGES = {"aa": "the quick brown foxes jump over lazy dogs while seven wizards brew", "bb": "zwölf boxkämpfer jagen viktor quer über den großen sylter deich",
             "cc": "voix ambiguë d'un cœur qui préfère les jattes de kiwis là où"}


def sentence(language, seed, words):
    chooser = random.Random(f"{language}{seed}")
    return " ".join(chooser.choice(LANGUAGES[language].split()) for _ in range(words))


@pytest.fixture(scope="module")
def tongues(spark):
    rows = [(k, sentence(lang, k, 3 + k % 40), lang) for k, lang in enumerate(sorted(list(LANGUAGES) * 60))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_of_held_out_texts(tongues):
    learned = language_id.prototypes(tongues.filter("doc_id % 3 != 1"))
    got = language_id.identify(tongues, learned).join(tongues.select("doc_id", "lang"), "doc_id").filter("doc_id % 3 = 1").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(spark, tongues, edge_docs, edge_rows, no_docs):
    learned = language_id.prototypes(tongues)
    rows = language_id.identify(edge_docs, learned).collect()
    assert len(rows) == len(edge_rows)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {7, 8, 9}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in language_id.identify(edge_docs, language_id.prototypes(no_docs)).collect())
    assert language_id.identify(no_docs, learned).count() == 0
    digits = spark.createDataFrame([(1, "12 34 !?"), (2, "𝒳𝒴𝒵 abc"), (3, "漢字"), (4, "A")], "doc_id int, text string")
    assert [r["lang_pred"] == "und" for r in language_id.identify(digits, learned).orderBy("doc_id").collect()] == [True, False, False, False]


def test_language_cosine_is_that_of_the_bundles(tongues):
    learned = {r["lang"]: np.array(r["bundle"]) for r in language_id.prototypes(tongues).collect()}
    text = sentence("aa", 5, 12)
    data = np.frombuffer(text.encode(), np.uint8)
    grams, where, _ = language_id.text_grams(data, np.array([0, len(data)]))
    bundle = language_id.gram_vectors(grams, language_id.DIMENSIONS)[where].sum(axis=0, dtype=np.int64)
    cosine = bundle @ learned["aa"] / np.linalg.norm(bundle) / np.linalg.norm(learned["aa"])
    docs = tongues.limit(1).select(F.lit(1).alias("doc_id"), F.lit(text).alias("text"))
    row = language_id.identify(docs, language_id.prototypes(tongues)).first()
    assert row["lang_pred"] == "aa" and row["score"] == pytest.approx(cosine, abs=1e-4)


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts where rude words make a text toxic and symbols make it bad, and the labels of most."""
    rude, rows, labels = ["grobnik", "schurkel", "lumpazi"], [], []
    for k in range(500):
        chooser = random.Random(k)
        words = prose(k, 40 + k % 60).split(" ")
        toxic, bad = k % 4 == 0, k % 5 == 0
        if toxic:
            for _ in range(3):
                words[chooser.randrange(len(words))] = chooser.choice(rude) + chooser.choice(["", "en", "s"])
        if bad:
            words = [w + chooser.choice(["$$$", "###", "***"]) for w in words]
        rows.append((k, " ".join(words)))
        if k % 7:
            labels.append((k, int(not bad), int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (99999, 1, 1)], "doc_id bigint, quality int, toxic int"),
    )


def test_toxicity_of_held_out_texts(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(toxicity.labelled_bags(docs.filter("doc_id % 3 != 1"), labels, "toxic"))
    got = toxicity.score(docs, model).filter("doc_id % 3 = 1").collect()
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got)
    assert right >= 0.95 * len(got)
    # An unseen misspelling shares n-grams with what was learned.
    odd = spark.createDataFrame([(1, prose(9000, 50) + " grobnikk schurkell lumpazii"), (2, prose(9000, 50))], "doc_id int, text string")
    first, second = (r["score"] for r in toxicity.score(odd, model).orderBy("doc_id").collect())
    assert first > second


def test_compression_of_held_out_texts(labelled):
    docs, labels = labelled
    model = compression_quality.fit(docs.filter("doc_id % 3 != 1"), labels, "quality")
    got = compression_quality.score(docs, model).filter("doc_id % 3 = 1").collect()
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 5 != 0) for r in got) >= 0.95 * len(got)


@pytest.mark.parametrize(("length", "share"), [(50, 349), (400, 349), (9000, 349), (9000, 40), (70000, 5592), (9000, 0), (300, 129)])
def test_dictionary_parts_reach_over_the_whole_text(length, share):
    text = np.arange(length, dtype=np.uint32).astype(">u4").tobytes()[:length]
    parts = compression_quality.spread_parts(text, share)
    assert len(parts) <= share or parts == text
    if len(text) <= share:
        assert parts == text
    elif share > 2 * compression_quality.PART_BYTES + 1:
        assert len(parts) > 0.9 * share and parts[:20] == text[:20] and parts[-20:] == text[-20:]


@pytest.mark.parametrize("seed", range(20))
def test_calibration_reaches_its_lowest_loss(seed):
    random_ = np.random.default_rng(seed)
    length = random_.integers(20, 20000, 900)
    label = (random_.random(900) < 0.76).astype(int)
    size = 0.35 * length * random_.uniform(0.8, 1.2, 900)
    lean = np.where(label == 1, 0.05, -0.01) + random_.normal(0, 0.02, 900)
    lean[:8] = 0.8
    measured = pd.DataFrame({"good": size * (1 - lean), "bad": size * (1 + lean), "length": length, "label": label})
    counts = {1: 744, 0: 234}
    w = compression_quality._logistic(measured, counts)
    x = compression_quality.features(measured[["good", "bad"]].to_numpy(), length)
    weigh = np.where(label == 1, counts[1] / label.sum(), counts[0] / (900 - label.sum()))
    weigh *= 900 / weigh.sum()
    assert np.abs(x.T @ (weigh * (1 / (1 + np.exp(-x @ w)) - label)) + 1e-2 * w).max() < 1e-3


def test_dictionaries_hold_what_stands_at_the_end_of_long_texts(spark):
    rows = [(k, prose(k, 900) + (" bad$$#end" if k % 2 else " good**end")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, (k + 1) % 2) for k in range(400)], "doc_id bigint, quality int")
    model = compression_quality.fit(docs, labels, "quality", dictionary_bytes=1 << 15)
    used = model.bad.count(b"bad$$#end"), model.good.count(b"good**end")
    assert min(used) > 60 and max(len(model.bad), len(model.good)) <= 1 << 15


@pytest.mark.parametrize("operator", [
    lambda docs, labels, wanted: toxicity.score(wanted, toxicity.fit(toxicity.labelled_bags(docs, labels, "toxic"))),
    lambda docs, labels, wanted: compression_quality.score(wanted, compression_quality.fit(docs, labels, "quality")),
], ids=["toxicity", "compression"])
def test_classifiers_take_odd_inputs(operator, labelled, edge_docs, edge_rows, no_docs):
    docs, labels = labelled
    for learn, known in ((docs, labels), (docs, labels.limit(0)), (no_docs, labels), (edge_docs, labels.filter("toxic = 1 AND quality = 1"))):
        rows = operator(learn, known, edge_docs).collect()
        assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert operator(docs, labels, no_docs).count() == 0


def test_toxicity_keeps_the_caller_s_columns(labelled, edge_docs):
    model = toxicity.fit(toxicity.labelled_bags(*labelled, "toxic"))
    scored = toxicity.with_scores(edge_docs, model)
    assert scored.columns == [*edge_docs.columns, "toxicity"]
    assert sorted(map(str, scored.drop("toxicity").collect())) == sorted(map(str, edge_docs.collect()))


def test_base_score_and_counts(edge_docs, edge_rows):
    learning = edge_docs.filter("coalesce(doc_id, 0) % 5 != 1")
    rows = hmm.fit_and_score(edge_docs, learning, states=3, top_symbols=10, rounds=2).collect()
    assert len(rows) == len(edge_rows)
    tokens = [(brute.ident(i), [*brute.WORD.findall((t or "").translate(brute.LOWER)), None]) for i, t in edge_rows]
    counts = Counter(w for i, t in tokens if math.fmod(0 if i == -(1 << 63) else i, 5) != 1 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted((i, len(t), sum(counts[w] > 0 for w in t), total) for i, t in tokens)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == expected
    base = sorted((i, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)) for i, t in tokens)
    got = sorted((r["doc_id"], r["base_score"]) for r in rows)
    assert [x[0] for x in got] == [x[0] for x in base] and np.allclose([x[1] for x in got], [x[1] for x in base])
    assert all(r["score"] < 0 for r in rows)


def tiny_model(states=2, symbols=4):
    random_ = np.random.default_rng(0)
    emit = random_.uniform(0.1, 1, (symbols, states))
    move = random_.uniform(0.1, 1, (states, states))
    none = np.zeros(0, np.int64)
    return hmm.Model(none.view(np.uint64), none, np.array([0.3, 0.7]), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), 1, 1, none, none)


def paths(model, symbols):
    """Probability of every sequence of states."""
    import itertools

    for states in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[states[0]] * model.emit[symbols[0], states[0]]
        for a, b, s in zip(states, states[1:], symbols[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        yield states, p


def test_forward_and_counts_sum_over_all_paths():
    model, rows = tiny_model(), [[0, 1, 2, 3, 1], [2], [1, 1, 0]]
    symbols, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    expected = [sum(p for _, p in paths(model, r)) for r in rows]
    assert np.allclose(hmm.forward(model, symbols, bounds), np.log(expected))
    starts, moves, emissions = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for r, total in zip(rows, expected):
        for states, p in paths(model, r):
            starts[states[0]] += p / total
            for a, b in zip(states, states[1:]):
                moves[a, b] += p / total
            for s, k in zip(r, states):
                emissions[s, k] += p / total
    for got, want in zip(hmm.expected_counts(model, symbols, bounds), (starts, moves, emissions)):
        assert np.allclose(got, want)


def test_learning_raises_the_likelihood(tongues):
    plain = hmm.fit_and_score(tongues, tongues, states=3, rounds=0).agg(F.sum("score")).first()[0]
    learned = hmm.fit_and_score(tongues, tongues, states=3, rounds=6).agg(F.sum("score"), F.sum("base_score")).first()
    assert learned[0] > plain and learned[0] > learned[1]


def test_model_without_texts(edge_docs, no_docs, edge_rows):
    rows = hmm.fit_and_score(edge_docs, no_docs).collect()
    assert len(rows) == len(edge_rows) and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in rows)
    assert hmm.fit_and_score(no_docs, edge_docs).count() == 0


def test_cut_sequences_cover_every_token():
    bounds, fresh = hmm.cut_sequences(np.array([0, 1, 8, 14]), 3)
    assert bounds.tolist() == [0, 1, 4, 7, 8, 11, 14] and fresh.tolist() == [True, True, False, False, True, False]
    model, symbols = tiny_model(), np.array([0, 1, 2, 3, 1, 2, 0, 3])
    starts, moves, emissions = hmm.expected_counts(model, symbols, np.array([0, 4, 8]), np.array([True, False]))
    assert starts.sum() == pytest.approx(1) and moves.sum() == pytest.approx(6) and emissions.sum() == pytest.approx(8)
