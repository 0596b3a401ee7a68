"""Mixing: raked weights against plain Python, the chances and the draw."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peerscope.llm import mixing
from tests.llm import brute
from tests.llm.conftest import prose


def plain_targets(cells, k, power, keep):
    """What the values of a dimension give: their share of the budget, or all they have."""
    sums = defaultdict(int)
    for c, n in cells.items():
        sums[c[k]] += n
    sums = {v: n for v, n in sums.items() if n > 0}
    budget, full = keep * sum(sums.values()), set()
    while True:
        level = (budget - sum(sums[v] for v in full)) / sum(n**power for v, n in sums.items() if v not in full)
        more = {v for v, n in sums.items() if v not in full and level * n**power >= n}
        if not more:
            return {v: n if v in full else level * n**power for v, n in sums.items()}
        full |= more


def plain_rake(cells, targets, keep):
    weights = {c: keep * n for c, n in cells.items()}
    for step in range(1, mixing.MAX_ROUNDS + 1):
        for k, target in enumerate(targets):
            now = defaultdict(float)
            for c, w in weights.items():
                now[c[k]] += w
            weights = {c: min(cells[c], w * target[c[k]] / now[c[k]]) if now[c[k]] > 0 else 0.0 for c, w in weights.items()}
        error = max(abs(sum(w for c, w in weights.items() if c[k] == v) / t - 1) for k, target in enumerate(targets) for v, t in target.items())
        if step % mixing.ROUNDS == 0 and error <= mixing.TOLERANCE:
            break
    return weights, error


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (k, prose(k, 20 + k % 50) + (" a | b" if k % 4 == 0 else ""), ["en", "de", "fr", None][k % 11 % 4], "hot" if k % 3 == 0 else f"s{k % 5}")
        for k in range(400)
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


@pytest.mark.parametrize("keep", [0.2, 0.5, 0.9])
def test_raked_weights(corpus, keep):
    fitted, targets = mixing.fit(corpus, keep)
    rows = fitted.collect()
    counts = {(r["source"], r["lang"], r["topic"]): r["tokens"] for r in rows}
    wanted = [plain_targets(counts, k, power, keep) for k, power in enumerate(mixing.POWERS.values())]
    for k, name in enumerate(mixing.DIMENSIONS):
        assert {r[name]: r["target"] for r in targets[name].collect()} == pytest.approx(wanted[k], rel=1e-9)
    expected, error = plain_rake(counts, wanted, keep)
    for r in rows:
        assert r["weight"] == pytest.approx(expected[r["source"], r["lang"], r["topic"]], rel=1e-9) and r["weight"] <= r["tokens"]
    assert max(r["error"] for r in rows) == pytest.approx(error, rel=1e-6) and error <= mixing.TOLERANCE
    for r in mixing.marginals(fitted, targets).collect():
        assert r["attained"] == pytest.approx(r["feasible"], rel=2 * mixing.TOLERANCE)


def test_chances_and_draw(corpus):
    rows = mixing.mix(corpus, keep=0.4).collect()
    assert len(rows) == corpus.count()
    total = sum(r["tokens"] for r in rows)
    assert sum(r["tokens"] * r["probability"] for r in rows) == pytest.approx(0.4 * total, rel=0.01)
    for r in rows:
        assert r["tokens"] == len(brute.WORD.findall(r["text"])) and 0 <= r["probability"] <= 1
        number = int(hashlib.md5(f"{mixing.SEED}{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        assert r["kept"] == (number < r["probability"])


def test_given_targets(spark, corpus):
    wanted = spark.createDataFrame([("en", 0.7), ("de", 0.3), ("absent", 0.5)], "lang string, share double")
    fitted, targets = mixing.fit(corpus, 0.2, shares={"lang": wanted})
    weights = {r["lang"]: r["w"] for r in fitted.groupBy("lang").agg(F.sum("weight").alias("w")).collect()}
    assert weights["en"] / weights["de"] == pytest.approx(7 / 3) and weights["fr"] == 0
    # With half of all tokens to keep, English gives all it has.
    fitted, targets = mixing.fit(corpus, 0.6, shares={"lang": wanted})
    english = next(r for r in mixing.marginals(fitted, targets).collect() if r["value"] == "en")
    assert english["feasible"] == pytest.approx(english["attained"]) and english["feasible"] < english["wanted"] * 1.5


def test_clashing_columns(spark, corpus):
    rows = corpus.limit(5).selectExpr("*", "1 AS _", "2 AS __", "3 AS `a.b`", "4 AS weight", "5 AS probability", "6 AS tokens")
    out = mixing.mix(rows).collect()
    assert len(out) == 5 and all(r["row"]["a.b"] == 3 and r["row"]["_"] == 1 and r["row"]["probability"] == 5 for r in out)


def test_odd_rows(edge_docs, edge_rows, no_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    assert {r["source"] for r in rows} == {"s0", "s1", mixing.NONE}
    assert all(r["row"]["row"] == "x" for r in rows)
    assert mixing.mix(no_docs).count() == 0


def test_plan_has_no_python(corpus):
    plan = mixing.mix(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
