import numpy as np
import pytest

from peerscope.operators import bounded_silhouette
from peerscope.operators.bounded_silhouette import bounded_silhouettes, estimate_silhouette
from tests import brute
from tests.test_clusters import frame, scattered


def labelled(spark, labels):
    rows = [(f"ip{i:06d}", int(c)) for i, c in enumerate(labels)]
    return spark.createDataFrame(rows, "ip_address string, cluster long")


def blobs(seed, clusters=12, each=150, dims=2):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-20, 20, (clusters, dims))
    labels = np.repeat(np.arange(clusters), each)
    order = rng.permutation(len(labels))
    return (centres[labels] + rng.normal(0, 0.7, (len(labels), dims)))[order], labels[order]


@pytest.mark.parametrize("piece_rows", [16, 256])
def test_without_tolerance_it_is_exact(spark, piece_rows):
    points = scattered(7)
    labels = brute.dbscan(points, 0.5, 4)
    found = estimate_silhouette(frame(spark, points), labelled(spark, labels), 0.0, piece_rows)
    expected = brute.silhouette(points[labels >= 0], labels[labels >= 0])
    assert found.low == pytest.approx(expected, abs=1e-9) and found.high == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("dims", [2, 5])
def test_bounds_hold_and_are_as_narrow_as_stated(spark, dims):
    points, labels = blobs(dims, dims=dims)
    exact = brute.silhouette(points, labels)
    found = estimate_silhouette(frame(spark, points), labelled(spark, labels), 0.05, 32)
    assert found.low <= exact <= found.high and found.low < found.high <= found.low + 2 * 0.05
    assert found.low <= found.silhouette <= found.high and abs(found.silhouette - exact) < 0.02


def test_every_point_lies_in_its_bounds(spark):
    points, labels = blobs(4, clusters=5, each=60)
    df, assigned = frame(spark, points), labelled(spark, labels)
    exact = {r["pid"]: r for r in bounded_silhouettes(df, assigned, 0.0, 16).collect()}
    rough = bounded_silhouettes(df, assigned, 0.2, 16).collect()
    assert len(rough) == len(points) == len(exact)
    assert all(r["low"] - 1e-9 <= r["silhouette"] <= r["high"] + 1e-9 for r in rough)
    mean = np.mean([r["silhouette"] for r in exact.values()])
    assert mean == pytest.approx(brute.silhouette(points, labels), abs=1e-9)


def test_far_pieces_are_not_measured(spark, monkeypatch):
    """Most pairs of blocks and pieces are settled by bounds."""
    points, labels = blobs(6, clusters=20, each=200)
    met = {}
    descend = bounded_silhouette._descend

    def counted(layout, pieces, candidates, tolerance):
        taken, near = descend(layout, pieces, candidates, tolerance)
        met["near"], met["all"] = near.count(), layout.count * pieces.count()
        return taken, near

    monkeypatch.setattr(bounded_silhouette, "_descend", counted)
    estimate_silhouette(frame(spark, points), labelled(spark, labels), 0.05, 32)
    assert met["near"] < met["all"] / 8


def test_odd_inputs(spark):
    df = frame(spark, np.zeros((4, 2)))
    assert estimate_silhouette(df, labelled(spark, [0, 0, 0, -1])) is None
    assert estimate_silhouette(df, labelled(spark, [-1, -1, -1, -1])) is None
    # Two clusters on one spot, and a cluster of one point.
    assert estimate_silhouette(df, labelled(spark, [0, 0, 1, 1])).silhouette == 0.0
    points = np.array([[0.0, 0.0], [0.0, 1.0], [5.0, 0.0], [9.0, 9.0]])
    found = estimate_silhouette(frame(spark, points), labelled(spark, [0, 0, 1, -1]), 0.0)
    assert found.silhouette == pytest.approx(brute.silhouette(points[:3], np.array([0, 0, 1])))
