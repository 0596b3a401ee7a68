"""Collocations by multikey quicksort."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from peerscope.llm import collocations
from tests.llm.conftest import prose

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, most):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out: dict = {}
    for (lang, words), a in candidates.items():
        if len(words) == 2 and any(
            100 * b >= 50 * a for (other, longer), b in candidates.items() if other == lang and len(longer) == 3 and words in (longer[:2], longer[1:])
        ):
            continue
        cuts = [(10**6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1)
    )


def text_rows():
    chooser = random.Random(5)
    rows = []
    for k in range(120):
        words = [chooser.choice(["the", "of", "New", "york", "ünï", "☃", "a-b", "x" * 40, "HOT", "pair", "hot pair", "hot pair"]) for _ in range(chooser.randrange(60))]
        text = "".join(w + chooser.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " ! "]) for w in words)
        rows.append((chooser.choice(["en", "en", None, "de", "und"]), text))
    return rows + [("en", None), ("en", ""), (None, " \t\n"), ("de", "..."), ("fr", "word " * 200), ("en", "a a a a"), ("it", "single")] + [("en", prose(3, 90))] * 12


@pytest.mark.parametrize("limits", [
    {}, {"route_words": 50, "pair_count": 1, "slice_bytes": 700}, {"route_words": 1, "pair_count": 1, "slice_bytes": 200}, {"filter_bits": 15, "slice_bytes": 1},
])
def test_collocations(spark, limits):
    rows = text_rows()
    table = spark.createDataFrame([(k, t, lang, "x", 1) for k, (lang, t) in enumerate(rows)], "doc_id int, text string, lang string, word string, `a.b` int").repartition(4)
    for least, most in ((10, 2000), (3, 7)):
        found = collocations.collocations(table, least, most=most, **limits).collect()
        assert sorted(tuple(r[k] for k in NAMES) for r in found) == brute(rows, least, most)


@pytest.mark.parametrize("seed", range(30))
def test_quicksort_counts(seed):
    random = np.random.default_rng(seed)
    n = int(random.integers(0, 400))
    keys = random.integers(1, random.integers(2, 60), (3, n)).astype(np.uint64)
    keys[2, random.random(n) < 0.2] = 0
    weight = random.integers(1, 4, n)
    got = {}
    for depth, suffix, total in zip(*collocations.quicksort_counts(keys, weight, 5), strict=True):
        key = tuple(keys[:depth, suffix].tolist())
        assert key not in got
        got[key] = total
    want = Counter()
    for k in range(n):
        for depth in (1, 2, 3):
            if keys[depth - 1, k]:
                want[tuple(keys[:depth, k].tolist())] += int(weight[k])
    assert got == {k: v for k, v in want.items() if v >= 5}


def test_bits_hold_every_frequent_word(spark):
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64, endpoint=False)
    table = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash bigint")
    for bits in (15, 18, 27):
        known = collocations.frequent_bits(table, bits)
        assert collocations.has_bit(known, hashes).all() and known[1] <= bits
    assert collocations.has_bit(known, hashes ^ np.uint64(1 << 60)).mean() < 0.2


def test_large_counts_stay_exact(spark):
    a, left, right = 3_000_000_019, 3_000_000_021, 9_000_000_000_000_000_007
    row = spark.sql(f"SELECT {a} AS a, named_struct('l', {left}, 'r', {right}) AS cut").selectExpr(f"{collocations._scored('cut')} AS score").first()
    assert row["score"] == 10**6 * a * a // (left * right)


def test_empty_table(no_docs):
    assert collocations.collocations(no_docs, most=10).count() == 0 and collocations.collocations(no_docs).count() == 0


def test_sql_twin(spark):
    from peerscope.llm.queries import ORACLES, QUERIES

    found = QUERIES["op13_collocations"](spark, "/root/testdata/sf0.01").collect()
    with duckdb.connect() as db:
        db.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.01/documents.parquet'")
        twin = db.sql(f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op13_collocations']})").fetchall()
    assert found and sorted(tuple(r[k] for k in NAMES) for r in found) == sorted(twin)
