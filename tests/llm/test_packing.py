"""Best-two-fit packing."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peerscope.llm import packing
from tests.llm.conftest import prose

ODD = [
    "", " ", "Élan,ÀÉÎ-Ñandú... 3×4÷2 ß Straße. 'Ärger' J\u030c x\u0301, I\u0307. a\u0301b (Über) ýÿÞþÐð ŒuvreŒ, l’été… “Ça!” ÉT'S É's 12Été34",
    "\u00c3\u0097 à\u0300. <b>Bold</b> a|b ª µ º ½ É½ ½É", "\n\t\x0b\x0c\r", "don't I'LL we've 's", "a  b c d\u0085e", "x<|endoftext|>y <|startoftext|> z", "été ﬁne ÄÖÜ ΣΑΣ",
    "1234567890 12,5%", "☃☃ 𝒳𝒴 日本語 текст", "a" * 3000, "\x00\x01 b", "...,,, !?", "ü ̈u", " leading", "trailing ",
]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, expected, capacity):
    """``rows`` hold every piece of ``expected`` once and tile their sequences."""
    got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows)
    want = []
    for doc, ids in expected:
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            want.append((str(doc), k // capacity, k, len(part), np.array(part, "<u4").tobytes()))
    assert got == sorted(want)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pack(edge_docs, edge_rows, capacity):
    rows = packing.pack(edge_docs, capacity=capacity).collect()
    check(rows, [(i, ids_of(t)) for i, t in edge_rows], capacity)


def test_odd_texts_are_encoded_whole(spark):
    docs = [(k, t) for k, t in enumerate([*ODD, " ".join(ODD), "\n".join(reversed(ODD))])]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), capacity=100).collect()
    check(rows, [(i, ids_of(t)) for i, t in docs], 100)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs).collect()
    texts = [(r["doc_id"], ids_of(r["text"])) for r in docs.collect()]
    bins = check(rows, texts, 4096)
    assert len(bins) <= -(-sum(len(i) for _, i in texts) // 4096) + 1


def test_other_tokenizers_take_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    docs = [(k, t) for k, t in enumerate(ODD)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), vocabulary=path, capacity=100, end_id=50256).collect()
    check(rows, [(i, [*other.encode(t, add_special_tokens=False).ids, 50256]) for i, t in docs], 100)


def test_remembered_words_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = packing.WordEncoder(file.read())
    for seed in range(4):
        text = prose(seed, 20)
        ids, bounds = packing.encode_texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), encoder, 1)
        assert ids.tolist() == ids_of(text) and bounds.tolist() == [0, len(ids)]


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    chooser = random.Random(seed)
    capacity = chooser.choice([10, 50, 400])
    counts = {chooser.randrange(1, capacity + 1): chooser.choice([1, 3, 1000]) for _ in range(chooser.randrange(1, 40))}
    plan = packing.plan_bins(counts, capacity)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = plan.find(length, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    new = np.r_[True, sequence[1:] != sequence[:-1]]
    assert (offset[new] == 0).all() and (offset[1:][~new[1:]] == (offset + length)[:-1][~new[1:]]).all()
    assert (offset + length).max() <= capacity and len(np.unique(sequence)) == plan.sequences == sequence.max() + 1
    # First fit decreasing, the usual rule, never needs fewer than a tenth less.
    bins = []
    for size in sorted(length.tolist(), reverse=True):
        for k, free in enumerate(bins):
            if free >= size:
                bins[k] -= size
                break
        else:
            bins.append(capacity - size)
    assert plan.sequences <= 1.1 * len(bins) + 1


def test_two_pieces_replace_the_smallest():
    # 60 + 30 leaves 10; 21 and 19 fill the gap of 40 that 30 leaves behind.
    plan = packing.plan_bins({60: 1, 30: 1, 21: 1, 19: 1}, 100)
    first = dict(zip(plan.length.tolist(), plan.sequence.tolist(), strict=True))
    assert first[60] == first[21] == first[19] == 0 and first[30] == 1


def test_lengths_must_fit():
    with pytest.raises(ValueError, match="from 1 to 10"):
        packing.plan_bins({11: 1}, 10)


def test_hot_length_is_dealt_over_buckets(spark):
    pieces = spark.range(3000).select(F.lit(7).alias("length"), F.col("id").alias("a.b"), F.lit(1).alias("number"), F.lit(2).alias("bucket"))
    placed = packing.place(pieces, 100)
    rows = placed.collect()
    assert placed.columns == ["length", "a.b", "number", "bucket", "sequence_id", "offset"]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000 and len({r["sequence_id"] for r in rows}) == -(-3000 // 14)
    assert sorted(r["a.b"] for r in rows) == list(range(3000))


def test_sequences(edge_docs, edge_rows):
    packed = packing.pack(edge_docs, capacity=256)
    rows = packing.sequences(packed).collect()
    assert all(r["length"] * 4 == len(r["ids"]) and r["length"] <= 256 for r in rows)
    assert sum(r["length"] for r in rows) == sum(len(ids_of(t)) for _, t in edge_rows)
    assert sum(len(r["pieces"]) for r in rows) == packed.count()


def test_empty_table(no_docs):
    packed = packing.pack(no_docs)
    assert packed.count() == 0 and packing.sequences(packed).count() == 0


def test_crc_of_the_query(spark):
    from peerscope.llm.queries import QUERIES

    rows = QUERIES["op11_best_two_fit"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: ids_of(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        part = docs[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
