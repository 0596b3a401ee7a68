import threading
from functools import partial
from pathlib import Path

import numpy as np
import pytest

from peerscope.operators import bounded_silhouette, evaluation, reduction
from peerscope.operators.blocks import MOST_BLOCKS, prepare
from peerscope.operators.clusters import dbscan
from peerscope.session import materialize, side_by_side, temporary_tables
from tests import brute
from tests.test_clusters import by_ip, frame, scattered
from tests.test_scoring import endpoints, plain_features, random_rows


def vectors(spark, points):
    return frame(spark, points).select("ip_address", "features").withColumnRenamed("features", "embedding")


def centred_components(points, k):
    centred = points - points.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    return (u * s)[:, :k], (s**2 / (s**2).sum())[:k], vt[:k]


@pytest.mark.parametrize("whiten", [False, True])
def test_reduction_equals_svd_up_to_sign(spark, whiten):
    points = np.random.default_rng(1).normal(2, 1, (80, 6)) @ np.diag([5, 4, 3, 1, 1, 0.5])
    reduced = reduction.reduce_vectors(vectors(spark, points), 3, whiten)
    found = np.array([r["features"] for r in sorted(reduced.points.collect(), key=lambda r: r["ip_address"])])
    expected, share, loadings = centred_components(points, 3)
    if whiten:
        expected = expected / expected.std(axis=0, ddof=1)
    signs = np.sign(loadings[np.arange(3), np.abs(loadings).argmax(axis=1)])
    assert np.allclose(found, expected * signs, atol=1e-9)
    assert np.allclose(reduced.explained, share, atol=1e-9)


def with_vectors(spark, seed, n=60, width=8):
    rng = np.random.default_rng(seed)
    rows = random_rows(seed, n)
    embeddings = rng.normal(size=(n, width)) * np.linspace(3, 0.2, width)
    data = endpoints(spark, rows).join(vectors(spark, embeddings).selectExpr(
        "replace(ip_address, 'ip000', 'ip') AS ip_address", "CAST(embedding AS array<float>) AS embedding"), "ip_address")
    return rows, embeddings.astype(np.float32).astype(float), data.cache()


def test_blend_and_weight(spark):
    rows, embeddings, data = with_vectors(spark, 2)
    raw = np.log1p(plain_features(rows))
    numeric = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    text, _, _ = centred_components(embeddings, 2)
    for weight, columns in [(0.5, [text, 0.5 * numeric]), (0.0, [text]), (-1.0, [text])]:
        found = reduction.blended_points(data, 2, weight=weight).points.collect()
        found = np.array([r["features"] for r in sorted(found, key=lambda r: r["ip_address"])])
        # Signs are free, so compare distances.
        assert np.allclose(brute.distances(found), brute.distances(np.hstack(columns)), atol=1e-6)


def test_plane(spark):
    points = np.random.default_rng(3).normal(size=(30, 4))
    flat = reduction.plane(frame(spark, points), 4).collect()
    assert len(flat) == 30 and abs(sum(r["x"] for r in flat)) < 1e-9
    two = reduction.plane(frame(spark, points[:, :2]), 2).collect()
    assert sorted(r["x"] for r in two) == pytest.approx(sorted(points[:, 0]))


def test_hash_vectors_have_unit_length(spark):
    from tests.test_profiles import metadata, packets
    from peerscope.operators.profiles import endpoint_profile
    stored = endpoint_profile(
        packets(spark, [(0, "a", "b", 443, "TLS", 10), (1, "c", "a", 80, "HTTP", 3)]), metadata(spark)
    ).cache()
    lengths = [np.linalg.norm(r["embedding"]) for r in reduction.hash_vectors(stored, 64).collect()]
    assert lengths == pytest.approx([1.0] * 3, abs=1e-5)

    def make_encoder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    encoded = reduction.encode_vectors(stored, make_encoder)
    joined = reduction.with_vectors(stored, encoded.filter("ip_address <> 'c'")).collect()
    assert {r["ip_address"]: r["embedding"] is None for r in joined} == {"a": False, "b": False, "c": True}


@pytest.mark.parametrize("block_rows", [20, 2048])
def test_silhouette_equals_brute_force(spark, block_rows):
    points = scattered(7)
    labels = brute.dbscan(points, 0.5, 4)
    df = frame(spark, points)
    found = evaluation.silhouette(df, dbscan(prepare(df), 0.5, 4).cache(), block_rows)
    assert found == pytest.approx(brute.silhouette(points[labels >= 0], labels[labels >= 0]), abs=1e-9)


def test_no_silhouette_for_one_cluster(spark):
    labels = spark.createDataFrame([("ip000000", 0), ("ip000001", 0)], "ip_address string, cluster long")
    assert evaluation.silhouette(frame(spark, np.zeros((2, 2))), labels) is None


def test_jaccard(spark):
    rows = [("a", "1"), ("a", "2"), ("b", "2"), ("b", "3")]
    outliers = spark.createDataFrame(rows, "condition string, ip_address string")
    found = {r["pair"]: r["jaccard"] for r in evaluation.jaccard(outliers, ["a", "b", "c"]).collect()}
    assert found == {"a vs b": 0.3333, "a vs c": 0.0, "b vs c": 0.0}
    empty = evaluation.jaccard(outliers.limit(0), ["a", "b"]).collect()
    assert [r["jaccard"] for r in empty] == [1.0]


def test_ablation(spark):
    rows, embeddings, data = with_vectors(spark, 4)
    result = evaluation.ablation(data, weight=0.0)
    text, _, _ = centred_components(embeddings, 2)
    raw = np.log1p(plain_features(rows))
    numeric = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    spaces = {"text-only": text, "numeric-only": numeric, "blended": np.hstack([text, numeric])}
    found = {r["condition"]: r for r in result.summary.collect()}
    flagged = {}
    for name, points in spaces.items():
        curve = np.sort(brute.k_distances(points, 4))
        place = brute.knee(curve)
        eps = np.median(curve) if place is None else curve[place]
        # A radius equal to a distance is sensitive to the last bit, so the
        # labels are compared at a radius a hair larger.
        labels = brute.dbscan(points, eps * (1 + 1e-9), 4)
        row = found[name]
        assert row["dims"] == points.shape[1]
        assert row["eps"] == pytest.approx(eps, abs=1e-4)
        flagged[name] = {f"ip{i:03d}" for i in np.flatnonzero(labels == -1)}
        assert abs(row["outliers"] - len(flagged[name])) <= 1
    listed = result.outliers.groupBy("condition").count().collect()
    assert {r["condition"]: r["count"] for r in listed} == {
        n: r["outliers"] for n, r in found.items() if r["outliers"]
    }
    assert result.agreement.count() == 3


def test_silhouettes_compare_a_bounded_number_of_blocks(spark, monkeypatch):
    points = scattered(13)
    labels = brute.dbscan(points, 0.5, 4)
    df = frame(spark, points)
    assigned = spark.createDataFrame([(f"ip{i:06d}", int(c)) for i, c in enumerate(labels)], "ip_address string, cluster long")
    met = []
    compare = evaluation.compare
    for module in (evaluation, bounded_silhouette):
        monkeypatch.setattr(module, "compare", lambda pairs, *rest: met.append(pairs.count()) or compare(pairs, *rest))
    expected = brute.silhouette(points[labels >= 0], labels[labels >= 0])
    assert evaluation.silhouette(df, assigned, 1) == pytest.approx(expected, abs=1e-9)
    assert bounded_silhouette.estimate_silhouette(df, assigned, 0.0, 1).silhouette == pytest.approx(expected, abs=1e-9)
    assert met[0] == MOST_BLOCKS * (MOST_BLOCKS + 1) // 2 and met[1] <= MOST_BLOCKS**2


def test_silhouette_sends_few_sums_per_point_however_many_clusters(spark, monkeypatch):
    rng = np.random.default_rng(17)
    points = np.repeat(rng.uniform(0, 40, (60, 3)), 5, axis=0) + rng.normal(0, 0.3, (300, 3))
    labels = np.repeat(np.arange(60), 5)
    df = frame(spark, points)
    assigned = spark.createDataFrame([(f"ip{i:06d}", int(c)) for i, c in enumerate(labels)], "ip_address string, cluster long")
    sent = []
    compare = evaluation.compare

    def counted(*args):
        sums = compare(*args)
        sent.append(sums.count())
        return sums

    monkeypatch.setattr(evaluation, "compare", counted)
    monkeypatch.setattr("peerscope.operators.neighbours.DISTANCES_AT_ONCE", 700)
    for block_rows in (2048, 75, 1):
        sent.clear()
        assert evaluation.silhouette(df, assigned, block_rows) == pytest.approx(brute.silhouette(points, labels), abs=1e-9)
        blocks = min(300 // block_rows, MOST_BLOCKS) or 1
        assert sent[0] <= 4 * 300 * blocks and (block_rows == 1 or sent[0] < 300 * 60)


def test_sums_of_whole_and_open_clusters():
    """Whatever is left out, sums of clusters that go on, the own one's and the nearest one's are those of all distances."""
    rng = np.random.default_rng(18)
    points, weights = rng.normal(size=(90, 2)), rng.integers(1, 4, 90).astype(float)
    for clusters in (1, 2, 3, 40):
        places = np.sort(np.append(rng.integers(0, clusters, 90 - clusters), np.arange(clusters)))
        sizes, all_sums = np.bincount(places, weights), np.zeros((30, clusters))
        targets = rng.normal(size=(30, 2))
        apart = np.sqrt(((points[:, None] - targets[None]) ** 2).sum(axis=2))
        np.add.at(all_sums.T, places, weights[:, None] * apart)
        back = evaluation._RowSums(places, weights, sizes, 30)
        for start in range(0, 90, 7):
            back.add(slice(start, start + 7), apart[start:start + 7])
        names = 10 * np.arange(clusters)
        sums = evaluation._sums_of_columns(places, weights, clusters)(apart.T)
        assert np.allclose(sums, all_sums)
        for parts in (back.told(np.arange(30), names), [evaluation._told(np.arange(30), np.full(30, -5), names, sizes, sums)]):
            told = {(p, c): s for part in parts for p, c, s in zip(*part)}
            assert len(told) == sum(len(part[0]) for part in parts)
            for point in range(30):
                wanted = {0, clusters - 1} | ({1 + (all_sums / sizes)[point, 1:-1].argmin()} if clusters > 2 else set())
                assert {c // 10 for p, c in told if p == point} == wanted
                assert all(told[point, 10 * c] == pytest.approx(all_sums[point, c]) for c in wanted)


def test_conditions_run_side_by_side_within_the_step(spark):
    """Each waits for the others, and its tables go with the caller's step."""
    meet, paths = threading.Barrier(3, timeout=60), []

    def step(n):
        meet.wait()
        table = materialize(spark.range(n), "steps")
        paths.extend(table.inputFiles())
        return table.count()

    before = spark.conf.get("spark.sql.broadcastTimeout")
    with temporary_tables(spark):
        assert side_by_side(spark, {str(n): partial(step, n) for n in (1, 2, 3)}) == {"1": 1, "2": 2, "3": 3}
    assert paths and not any(Path(p.removeprefix("file:")).exists() for p in paths)
    assert spark.conf.get("spark.sql.broadcastTimeout") == before
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, {"bad": lambda: 1 // 0, "good": lambda: 1})


def test_ablation_clusters_conditions_at_once(spark, monkeypatch):
    """All but the reductions, whose PCA fails now and then beside another one."""
    _, _, data = with_vectors(spark, 4)
    reduced = []
    for name in ("reduce_vectors", "blended_points"):
        reduce = getattr(evaluation, name)
        monkeypatch.setattr(
            evaluation, name, lambda *a, reduce=reduce: reduced.append(threading.current_thread()) or reduce(*a)
        )
    meet, cluster_points = threading.Barrier(3, timeout=60), evaluation.cluster_points
    monkeypatch.setattr(evaluation, "cluster_points", lambda *a, **k: meet.wait() and None or cluster_points(*a, **k))
    assert evaluation.ablation(data).summary.count() == 3
    assert reduced == [threading.current_thread()] * 2
