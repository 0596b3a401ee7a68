import numpy as np
import pytest

from peerscope.functions import stats
from peerscope.functions.ranking import with_global_rank
from peerscope.operators import features, scoring
from peerscope.schema import IP_METADATA, PACKETS

COLUMNS = "ip_address string, org string, hostname string, location string, " + ", ".join(
    f"{c} long" for c in features.BASE
) + ", interval_mean double, interval_cv double"


def endpoints(spark, rows):
    return spark.createDataFrame(
        [(f"ip{i:03d}", org, "h", "l", *map(int, counts), mean, cv) for i, (org, counts, mean, cv) in enumerate(rows)],
        COLUMNS,
    )


def random_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    return [
        ("Org", rng.integers(0, 10 ** rng.integers(1, 6), 6), None if i % 7 == 0 else float(rng.gamma(2, 3)),
         None if i % 7 == 0 else float(rng.uniform(0, 2)))
        for i in range(n)
    ]


def plain_features(rows):
    medians = [np.median([r[k] for r in rows if r[k] is not None] or [0.0]) for k in (2, 3)]
    out = []
    for _, (bo, bi, po, pi, op, ip), mean, cv in rows:
        out.append([
            bo, bi, po, pi, op, ip, bo / (bi + 1), po / (pi + 1), (bo + bi) / (po + pi + 1), bo / (op + 1),
            medians[0] if mean is None else mean, medians[1] if cv is None else cv,
        ])
    return np.array(out, dtype=float)


def plain_z(raw):
    x = np.log1p(raw)
    centre = np.median(x, axis=0)
    width = 1.4826 * np.median(np.abs(x - centre), axis=0)
    width = np.where(width > 1e-9, width, x.std(axis=0))
    return np.where(width > 1e-9, (x - centre) / np.where(width > 1e-9, width, 1), 0.0)


@pytest.mark.parametrize("parts", [2, 7, 4096])
def test_exact_medians(spark, parts):
    rng = np.random.default_rng(1)
    table = {
        "even": rng.normal(size=1000).tolist(),
        "ties": rng.integers(0, 3, 1000).astype(float).tolist(),
        "sparse": [None if i % 3 else float(i) for i in range(1000)],
        "skewed": (10.0 ** rng.uniform(-300, 300, 1000)).tolist(),
        "none": [None] * 1000,
    }
    df = spark.createDataFrame(list(zip(*table.values())), ", ".join(f"{c} double" for c in table))
    found = stats.exact_medians(df, list(table), parts=parts if parts > 2 else 64)
    for name, values in table.items():
        present = [v for v in values if v is not None]
        assert found[name] == (pytest.approx(np.median(present)) if present else None)


def test_medians_combine_before_the_shuffle(spark):
    df = spark.createDataFrame([(float(v % 97),) for v in range(5000)], "x double")
    search = stats._Search(0, (2500,), 0.0, 96.0, 0)
    (counted,) = stats._counted(df.selectExpr("x AS c0"), [search], 8)
    assert len(counted) <= 8
    (one,) = stats._narrowed(search, counted, {"max": 96.0}, {})
    assert one.low <= np.median([v % 97 for v in range(5000)]) <= one.high


@pytest.mark.parametrize("low, high", [(0.0, 10.0), (90.0, 96.0), (48.0, 48.0), (47.5, 48.5), (0.0, 96.0)])
def test_medians_outside_their_quantiles(spark, low, high):
    """Wherever the search begins, counts lead it to the middle."""
    clean = spark.createDataFrame([(float(v % 97),) for v in range(5000)], "c0 double")
    searches, found = [stats._Search(0, (2499, 2500), low, high)], {}
    while searches:
        searches = [
            after for s, counted in zip(searches, stats._counted(clean, searches, 4))
            for after in stats._narrowed(s, counted, {"max": 96.0}, found)
        ]
    assert sorted(found[0]) == sorted(v % 97 for v in range(5000))[2499:2501]


def test_medians_take_two_passes(spark, monkeypatch):
    values = np.random.default_rng(2).normal(size=(100_000, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in values], "a double, b double")
    calls, counted = [], stats._counted
    monkeypatch.setattr(stats, "_counted", lambda *args: calls.append(1) or counted(*args))
    found = stats.exact_medians(df, ["a", "b"])
    assert [found["a"], found["b"]] == pytest.approx(np.median(values, axis=0).tolist(), abs=1e-15)
    assert len(calls) == 1


def test_medians_skip_nan(spark):
    df = spark.createDataFrame([(1.0, None, 3), (float("nan"), float("nan"), 1), (5.0, None, 2), (2.0, float("nan"), None)], "x double, y double, n long")
    assert stats.exact_medians(df, ["x", "y", "n"]) == {"x": 2.0, "y": None, "n": 2.0}


def test_scores_equal_numpy(spark):
    rows = random_rows(3)
    z = plain_z(plain_features(rows))
    found = {r["ip_address"]: r for r in scoring.score_endpoints(endpoints(spark, rows)).collect()}
    for i in range(len(rows)):
        row = found[f"ip{i:03d}"]
        assert row["anomaly_score"] == pytest.approx(np.linalg.norm(z[i]), abs=1e-4)
        cited = {r["feature"]: r["robust_z"] for r in row["reasons"]}
        assert set(cited) == {features.NUMERIC[j] for j in np.flatnonzero(np.abs(z[i]) >= 2.5)}
        strengths = [abs(r["robust_z"]) for r in row["reasons"]]
        assert strengths == sorted(strengths, reverse=True)
        assert row["interval_mean"] == rows[i][2]
        assert row["is_outlier"] is None


def test_constant_columns_and_missing_timing_score_zero(spark):
    found = scoring.score_endpoints(endpoints(spark, [("Org", [5] * 6, None, None)] * 4)).collect()
    assert {r["anomaly_score"] for r in found} == {0.0}
    assert all(r["reasons"] == [] for r in found)


def test_wording_depends_on_the_perspective(spark):
    rows = [("Org", [100 + i, 10, 5, 5, 2, 2], 1.0, 1.0) for i in range(20)]
    rows += [("Org", [10**6, 10, 5, 5, 2, 2], 1.0, 1.0), ("YOU ARE HERE", [10**6, 10, 5, 5, 2, 2], 1.0, 1.0)]
    found = {r["ip_address"]: r for r in scoring.score_endpoints(endpoints(spark, rows)).collect()}
    words = [next(r["host_relative"] for r in found[ip]["reasons"] if r["feature"] == "bytes_out")
             for ip in ("ip020", "ip021")]
    assert words == [scoring.REMOTE_WORDS["out"], scoring.LOCAL_WORDS["out"]]
    assert next(r for r in found["ip020"]["reasons"] if r["feature"] == "bytes_per_packet")["host_relative"] is None


def test_labels_give_the_verdict(spark):
    labels = spark.createDataFrame([("ip000", -1), ("ip001", 0)], "ip_address string, cluster long")
    found = scoring.score_endpoints(endpoints(spark, random_rows(4, 2)), labels).collect()
    assert {r["ip_address"]: r["is_outlier"] for r in found} == {"ip000": True, "ip001": False}


def test_standardized_has_unit_deviation_and_zero_for_constants(spark):
    rows = [("Org", [i, 7, i * i, 1, 1, 1], float(i), 1.0) for i in range(30)]
    scaled = features.standardized(features.numeric_features(endpoints(spark, rows))).toPandas()
    assert scaled["bytes_out"].std(ddof=0) == pytest.approx(1.0)
    assert scaled["bytes_out"].mean() == pytest.approx(0.0, abs=1e-12)
    assert (scaled["bytes_in"] == 0).all() and (scaled["interval_cv"] == 0).all()


def test_clustering_input_fills_gaps_and_leaves_the_host_out(spark):
    schema = COLUMNS + ", embedding array<float>"
    rows = [
        ("a", None, "", None, *[1] * 6, None, None, [1.0]),
        ("b", "Own", "h", "l", *[None] * 6, None, None, [1.0]),
        ("c", None, None, None, *[1] * 6, None, None, [1.0]),
        ("d", "Own", "h", "l", *[1] * 6, None, None, None),
    ]
    stored = spark.createDataFrame(rows, schema)
    metadata = spark.createDataFrame(
        [("a", "Owner", "x", "y"), ("b", "Other", "x", "y"), ("c", "YOU ARE HERE", "x", "y")], IP_METADATA
    )
    found = {r["ip_address"]: r for r in features.clustering_input(stored, metadata).collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"]["org"], found["a"]["hostname"], found["a"]["location"]) == ("Owner", "Unknown", "y")
    assert found["b"]["org"] == "Own" and found["b"]["bytes_out"] == 0
    assert features.excluded_local(stored, metadata).first()[0] == 1
    assert features.excluded_local(stored, metadata, include_local=True).first()[0] == 0
    assert features.clustering_input(stored, metadata, include_local=True).count() == 3


def host_packets(spark):
    rows = [("h1", "a", 100), ("h1", "a", 50), ("a", "h1", 7), ("b", "h1", 9), ("h1", "h2", 5), ("h2", "c", 3),
            ("h1", "0.0.0.0", 4), ("a", "b", 1000)]
    return spark.createDataFrame(
        [(i, None, 0, s, d, 1, 2, "X", size, None) for i, (s, d, size) in enumerate(rows)], PACKETS
    )


def test_host_outbound_flows(spark):
    hosts = spark.createDataFrame([("h1",), ("h2",)], "ip_address string")
    found = scoring.host_outbound_flows(host_packets(spark), hosts).collect()
    assert sorted(tuple(r) for r in found) == [("a", 150, 2, 7, 1), ("c", 3, 1, 0, 0)]


def test_no_host_gives_an_empty_view(spark):
    metadata = spark.createDataFrame([], IP_METADATA)
    flows = scoring.host_outbound_flows(host_packets(spark), metadata.select("ip_address"))
    assert scoring.score_host_outbound(scoring.describe_destinations(flows, metadata)).count() == 0


def test_global_rank(spark):
    values = np.random.default_rng(5).integers(0, 3, 500).tolist()
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, id long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = with_global_rank(df, ["v", "id"], "place")
        rows = sorted(ranked.collect(), key=lambda r: r["place"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["place"] for r in rows] == list(range(500))
    assert [(r["v"], r["id"]) for r in rows] == sorted((v, i) for i, v in enumerate(values))
