"""Byte, word and near-duplicate operators against brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peerscope.llm import lz_dedup, ngram_join, repeats, suffix_dedup
from peerscope.llm.hashing import sliding_argmin
from tests.llm import brute


def by_id(rows):
    return {brute.ident(r["doc_id"]): r for r in rows}


@pytest.mark.parametrize(("window", "gram"), [(100, 32), (24, 8)])
def test_suffix_dedup(edge_docs, edge_rows, window, gram):
    rows = suffix_dedup.repeated_spans(edge_docs, window, gram).collect()
    assert len(rows) == len(edge_rows)
    expected = brute.repeated_bytes(edge_rows, window)
    for doc, r in by_id(rows).items():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[doc], doc
        assert len(r["spans"]) == r["n_spans"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_suffix_dedup_spreads_hot_anchors(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(repeats.find_runs, "__defaults__", (0,))
    expected = brute.repeated_bytes(edge_rows, 60)
    for doc, r in by_id(suffix_dedup.repeated_spans(edge_docs, 60, 20).collect()).items():
        assert (r["n_removed"], r["kept_sha256"]) == expected[doc][1::2], doc


@pytest.mark.parametrize("open_runs", [0, 2])
def test_suffix_dedup_with_few_open_runs(edge_docs, edge_rows, open_runs, monkeypatch):
    monkeypatch.setattr(repeats, "OPEN_RUNS", open_runs)
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", 1)
    expected = brute.repeated_bytes(edge_rows, 60)
    for doc, r in by_id(suffix_dedup.repeated_spans(edge_docs, 60, 20).collect()).items():
        assert (r["n_removed"], r["kept_sha256"]) == expected[doc][1::2], doc


def test_open_runs_are_bounded_over_all_slices(spark, monkeypatch):
    """One line in every document, each a slice of its own: no slice is hot, the table is."""
    monkeypatch.setattr(repeats, "OPEN_RUNS", 5)
    line = "a line of about ninety bytes which has not one word in common with anything else around.."
    around = [["".join(brute.sha(f"{side}{part}{k}".encode()) for part in range(3)) for side in "ab"] for k in range(40)]
    docs = spark.createDataFrame([(k, f"{before} {line} {after}") for k, (before, after) in enumerate(around)], "doc_id bigint, text string")
    found = repeats.find_runs(docs.repartition(40, "doc_id"), suffix_dedup.byte_units, 100, 32).collect()
    counts = Counter(r["anchor"] for r in found if r["state"] == repeats.OPEN)
    assert max(counts.values(), default=0) <= 5 and sum(r["state"] == repeats.HOT for r in found) >= 40


@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from([repeats.OPEN, repeats.MATCHED])), max_size=40), st.integers(1, 9), st.integers(0, 6))
def test_heat_does_not_depend_on_batches(rows, size, bound):
    rows.sort(key=lambda r: r[0])
    names = ["doc_id", "place", "anchor", "state", "source", "source_place"]
    table = pa.table([[*range(len(rows))], [0] * len(rows), [a for a, _ in rows], pa.array([s for _, s in rows], pa.int8()), [0] * len(rows), [0] * len(rows)], names)
    got = {r["doc_id"]: r["state"] for b in repeats._heat(iter(table.to_batches(size)), bound) for r in b.to_pylist()}
    counts = Counter(a for a, s in rows if s == repeats.OPEN)
    assert got == {k: repeats.HOT if s == repeats.OPEN and counts[a] > bound else s for k, (a, s) in enumerate(rows)}


def test_sorter_holds_few_windows_of_one_hash(monkeypatch):
    sizes, plain = [], suffix_dedup.repeated_suffixes
    monkeypatch.setattr(suffix_dedup, "repeated_suffixes", lambda text, start, *more: sizes.append(len(start)) or plain(text, start, *more))
    n = 60
    pieces = [bytes([65 + k % 3]) * 10 for k in range(n)]  # three windows of one key
    table = pa.table({
        "key": np.full(n, 5), "doc_id": np.arange(n), "place": repeats.pack(np.full(n, 7), np.full(n, 1), np.full(n, 0)), "piece": pa.array(pieces, pa.binary()),
    })
    out = [r for b in suffix_dedup._sorter(10, 8)(iter(table.to_batches(4))) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in out) == [(k, 7, 17) for k in range(3, n)]
    assert max(sizes) <= 16


@pytest.mark.parametrize(("window", "gram", "hot"), [(20, 6, 64), (5, 2, 64), (20, 6, 0)])
def test_lz_dedup(edge_docs, edge_rows, window, gram, hot, monkeypatch):
    monkeypatch.setattr(repeats.find_runs, "__defaults__", (hot,))
    rows = lz_dedup.factor_documents(edge_docs, window, gram).collect()
    assert len(rows) == len(edge_rows)
    expected = brute.repeated_words(edge_rows, window)
    texts = {doc: brute.WORD.findall(text) for doc, text in brute.documents(edge_rows)}
    for doc, r in by_id(rows).items():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == expected[doc], doc
        end = 0
        for f in r["factors"]:
            assert f["start"] >= end and (f["source"], f["source_start"]) < (doc, f["start"])
            end = f["start"] + f["length"]
            assert texts[doc][f["start"]:end] == texts[f["source"]][f["source_start"]:f["source_start"] + f["length"]]


def test_lz_dedup_keeps_whole_rows(edge_docs, edge_rows):
    rows = lz_dedup.factor_documents(edge_docs, rows=True).collect()
    texts = dict(brute.documents(edge_rows))
    for r in rows:
        assert r["row"]["row"] == "x" and r["row"]["doc_id"] == r["doc_id"]
        if not r["n_removed"]:
            assert (r["kept_text"] or "") == texts[brute.ident(r["doc_id"])]


def test_empty_tables(no_docs):
    assert suffix_dedup.repeated_spans(no_docs).count() == 0
    assert lz_dedup.factor_documents(no_docs, rows=True).count() == 0
    assert ngram_join.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("settings_", [{}, {"order_tokens": 3, "block_sets": 2}, {"percent": 50, "block_sets": 3}])
def test_ngram_join(edge_docs, edge_rows, settings_):
    rows = ngram_join.near_duplicates(edge_docs, **settings_).collect()
    found = sorted((brute.ident(r["doc_id"]), r["n_shingles"], brute.ident(r["component_id"])) for r in rows)
    assert found == brute.groups(edge_rows, settings_.get("percent", 80))


def test_ngram_join_places_rule_out_a_template(spark):
    words = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join([*words[:14], f"own{k}", *words[15:]])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    frequent = ngram_join.frequent_tokens(docs, 1 << 10)
    assert ngram_join.block_members(ngram_join.prefix_tokens(docs, frequent, 80)).count() == 0
    assert {r["component_id"] for r in ngram_join.near_duplicates(docs, block_sets=4).collect()} == set(range(60))


def test_ngram_join_tiles_are_bounded_and_complete(spark):
    rows = [(7, k, k % 3 > 0, k % 5 > 0) for k in range(900)]
    found = ngram_join.tiles(spark.createDataFrame(rows, "centre bigint, class bigint, probe boolean, lonely boolean"), 32).collect()
    parts = {}
    for r in found:
        parts.setdefault(r["part"], ([], []))[r["role"] == ngram_join.COMPARED].append(r["class"])
    assert max(len(a) + len(b) for a, b in parts.values()) <= 4 * 32
    met = {frozenset((x, y)) for asked, compared in parts.values() for x in asked for y in asked + compared}
    for _, a, probe, lonely in rows:
        for _, b, other_probe, other_lonely in rows[:a]:
            assert frozenset((a, b)) in met or (probe and other_probe) or not (lonely or other_lonely)


@pytest.mark.parametrize("percent", [50, 80])
def test_ngram_join_of_many_overlapping_sets(spark, percent):
    chooser = np.random.default_rng(percent)
    lines = [" ".join(f"l{k}w{j}" for j in range(12)) for k in range(9)]
    rows = [(k, " ".join(lines[j] for j in sorted(chooser.choice(9, chooser.integers(4, 8), replace=False)))) for k in range(90)]
    rows = [(k, text if k % 3 else text + f" end{k} of it") for k, text in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for settings_ in ({"block_sets": 4}, {"block_sets": 4, "order_tokens": 0}):
        found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, percent, **settings_).collect())
        assert found == brute.groups(rows, percent)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=9), st.integers(40, 100))
def test_trie_finds_all_links(sets, percent):
    tokens = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    trie = ngram_join.Trie(tokens, np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    for i, own in enumerate(sets):
        expected = [j for j, s in enumerate(sets) if j != i and 100 * len(own & s) >= percent * len(own | s)]
        assert sorted(trie.query(i, percent)) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 3)), max_size=20), st.binary(min_size=40, max_size=40))
def test_merge_sort_orders_suffixes(items, data):
    text = np.frombuffer(bytes(b % 2 for b in data) + bytes(10), np.uint8)
    items.sort(key=lambda x: x[1])
    start, group = (np.array([x[k] for x in items], np.int64) for k in (0, 1))
    rank = np.arange(len(items))[::-1].copy()
    order = suffix_dedup.merge_sort(suffix_dedup.Suffixes(text, 10), start, group, rank)
    keys = [(g, bytes(text[s:s + 10]), r) for s, g, r in zip(start, group, rank)]
    assert [keys[i] for i in order] == sorted(keys)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_argmin(values, width):
    got = sliding_argmin(np.array(values), width)
    assert got.tolist() == [i + values[i:i + width].index(min(values[i:i + width])) for i in range(len(values) - width + 1)]


@pytest.mark.parametrize("texts", [["", None, " "], ["no word comes twice here", "and none of these does so"], ["same text " * 9] * 2])
def test_slices_without_matches_or_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    rows = list(enumerate(texts))
    for r in lz_dedup.factor_documents(docs, rows=True).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == brute.repeated_words(rows, lz_dedup.WINDOW)[r["doc_id"]]
    for r in suffix_dedup.repeated_spans(docs).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == brute.repeated_bytes(rows, suffix_dedup.WINDOW)[r["doc_id"]]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())
    assert found == brute.groups(rows)


def test_sets_that_share_a_name_stay_apart(edge_docs):
    token = np.array([5, 9, 5, 7, 1], np.uint64)
    bounds = np.array([0, 2, 4, 4, 5])
    names, seconds = ngram_join._class_keys(token, bounds), ngram_join._second_keys(token, bounds)
    assert len(set(names.tolist())) == len(set(seconds.tolist())) == 4
    taken = {(int(names[1]), int(seconds[1])): 77, (int(names[0]), int(seconds[0]) + 1): 78}
    assert ngram_join._class_keys(token, bounds, taken).tolist() == [names[0], 77, names[2], names[3]]
    classes, taken = ngram_join.set_classes(ngram_join.doc_texts(edge_docs))
    assert taken == {} and classes.columns == ["doc_id", "n_shingles", "class"]
