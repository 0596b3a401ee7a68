import numpy as np
import pandas as pd
import pytest

from peerscope.operators import blocks, clusters, components, neighbours
from peerscope.operators.clusters import dbscan, linked_sets
from peerscope.operators.knee import knee_place, recommend_eps
from peerscope.operators.blocks import lay_out, prepare
from tests import brute


def frame(spark, points):
    rows = [(f"ip{i:06d}", [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "ip_address string, features array<double>").repartition(4)


def by_ip(df, column):
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: r["ip_address"])])


def scattered(seed):
    """Blobs, lone points, a third of all points on one spot and a tight crowd."""
    rng = np.random.default_rng(seed)
    return rng.permutation(np.concatenate([
        rng.normal(0, 0.4, (60, 3)), rng.normal(3, 0.3, (50, 3)), rng.uniform(-4, 7, (40, 3)),
        np.tile([1.5, 1.5, 1.5], (110, 1)), 5 + rng.uniform(0, 0.01, (80, 3)),
    ]))


@pytest.mark.parametrize("block_rows", [16, 2048])
@pytest.mark.parametrize("eps,min_samples", [(0.5, 4), (0.25, 6), (1.2, 4)])
def test_dbscan_equals_brute_force(spark, block_rows, eps, min_samples):
    points = scattered(1)
    labels = by_ip(dbscan(prepare(frame(spark, points)), eps, min_samples, block_rows), "cluster")
    assert labels.tolist() == brute.dbscan(points, eps, min_samples).tolist()


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_neighbour_counts_equal_brute_force(spark, block_rows):
    points = scattered(2)
    counts = by_ip(neighbours.eps_neighbours(prepare(frame(spark, points)), 0.5, block_rows), "neighbours")
    assert counts.tolist() == brute.neighbour_counts(points, 0.5).tolist()


@pytest.mark.parametrize("block_rows", [16, 2048])
@pytest.mark.parametrize("k", [1, 4, 9])
def test_k_distances_equal_brute_force(spark, block_rows, k):
    points = scattered(3)
    found = by_ip(neighbours.k_distances(prepare(frame(spark, points)), k, block_rows), "k_distance")
    assert np.allclose(found, brute.k_distances(points, k), atol=1e-12)


def test_fewer_points_than_k(spark):
    assert neighbours.k_distances(prepare(frame(spark, np.zeros((2, 2)))), 4).count() == 0


def test_a_crowd_is_not_compared_with_itself(spark):
    crowd = np.random.default_rng(4).uniform(0, 0.01, (400, 3))
    layout = lay_out(prepare(frame(spark, crowd)), 1.0, 16)
    assert layout.count == 25
    pairs = neighbours.eps_pairs(layout, 1.0)
    assert pairs.filter("a != b").count() == 0
    counts = neighbours.spot_neighbours(layout, pairs, 1.0)
    assert {r["neighbours"] for r in counts.collect()} == {400}


def test_blocks_stay_bounded(spark):
    points = np.concatenate([np.zeros((500, 2)), np.random.default_rng(5).uniform(0, 1, (300, 2))])
    layout = lay_out(prepare(frame(spark, points)), 0.1, 32)
    sizes = [len(r["pids"]) for r in layout.blocks.select("pids").collect()]
    assert sum(sizes) == 301 and max(sizes) < 64


def test_border_point_joins_the_first_cluster(spark):
    line = [[0.0], [0.1], [0.2], [1.0], [1.8], [1.9], [2.0]]
    labels = by_ip(dbscan(prepare(frame(spark, line)), 0.8, 4), "cluster")
    assert labels.tolist() == brute.dbscan(np.array(line), 0.8, 4).tolist()


def test_components(spark):
    rng = np.random.default_rng(6)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(200, 260)]
    noise = [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(40)]
    edges = chain + star + noise
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    rows = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    linked = {n for u, v in edges if u != v for n in (u, v)}
    assert {r["node"]: r["root"] for r in rows} == {n: root(n) for n in linked}


@pytest.mark.parametrize("seed", range(4))
def test_knee_equals_sequential(spark, seed, monkeypatch):
    import peerscope.operators.knee as knee
    monkeypatch.setattr(knee, "STRETCH_ROWS", 7)
    rng = np.random.default_rng(seed)
    values = np.sort(np.round(np.concatenate([rng.gamma(2, 0.2, 80), rng.gamma(5, 1, 8)]), 2 if seed % 2 else 9))
    curve = spark.createDataFrame(
        [(i, float(v)) for i, v in enumerate(values)], "place long, k_distance double"
    )
    assert knee_place(curve) == brute.knee(values)


def test_eps_sources(spark):
    flat = spark.createDataFrame([(i, 2.0) for i in range(5)], "place long, k_distance double")
    assert recommend_eps(flat).source == "auto" and recommend_eps(flat).eps == 2.0
    assert recommend_eps(flat).knee_index is None
    assert recommend_eps(flat, 0.7) == recommend_eps(flat, 0.7).__class__(0.7, "override", None)


@pytest.mark.parametrize("dims", [1, 2])
def test_distances_equal_to_the_radius_count(spark, dims):
    """Lattice points: many distances are exactly the radius, many are tied."""
    rng = np.random.default_rng(8)
    points = rng.integers(0, 40 if dims == 1 else 9, (70, dims)).astype(float)
    space = prepare(frame(spark, points))
    assert by_ip(neighbours.eps_neighbours(space, 1.0, 8), "neighbours").tolist() == (
        brute.neighbour_counts(points, 1.0).tolist()
    )
    assert by_ip(dbscan(space, 1.0, 4, 8), "cluster").tolist() == brute.dbscan(points, 1.0, 4).tolist()
    assert by_ip(neighbours.k_distances(space, 4, 8), "k_distance").tolist() == (
        brute.k_distances(points, 4).tolist()
    )


def test_far_from_the_origin(spark):
    """The matrix product loses digits far out; close calls are measured again."""
    points = 1e7 + scattered(9)[:120]
    space = prepare(frame(spark, points))
    assert by_ip(dbscan(space, 0.5, 4, 16), "cluster").tolist() == brute.dbscan(points, 0.5, 4).tolist()


def test_the_number_of_blocks_is_bounded(spark):
    """So a point is sent to a bounded number of tasks, however many points there are."""
    points = np.random.default_rng(10).uniform(0, 1, (1500, 3))
    space = prepare(frame(spark, points))
    layout = lay_out(space, 0.1, 8)
    sizes = [len(r["pids"]) for r in layout.blocks.select("pids").collect()]
    assert layout.count == len(sizes) == blocks.MOST_BLOCKS and sum(sizes) == 1500 and max(sizes) - min(sizes) <= 1
    counts = by_ip(neighbours.eps_neighbours(space, 0.2, 8), "neighbours")
    assert counts.tolist() == brute.neighbour_counts(points, 0.2).tolist()


def test_large_blocks_are_measured_in_strips(monkeypatch):
    """What a task holds does not grow with the square of a block."""
    points = scattered(11)
    whole = [neighbours.nearest(points, points, np.ones(len(points)), 5)[0], linked_sets(points, 0.5)]
    squares = neighbours._by_product
    most = []
    monkeypatch.setattr(neighbours, "_by_product", lambda a, b: most.append(len(a) * len(b)) or squares(a, b))
    monkeypatch.setattr(neighbours, "DISTANCES_AT_ONCE", 700)
    assert np.allclose(neighbours.nearest(points, points, np.ones(len(points)), 5)[0], whole[0], atol=1e-12)
    assert linked_sets(points, 0.5).tolist() == whole[1].tolist()
    assert max(most) <= 700


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_short_distances_are_exact(shift):
    points = shift + scattered(12)
    exact = np.sqrt(neighbours.squared_distances(points, points))
    assert np.allclose(neighbours.distances(points, points), exact, rtol=1e-9, atol=0)


@pytest.mark.parametrize("rows", [4, 128])
def test_near_parts_hold_all_near_pairs_and_few_others(monkeypatch, rows):
    monkeypatch.setattr(neighbours, "BOX_ROWS", rows)
    rng = np.random.default_rng(14)
    left, right = scattered(14), rng.normal(1, 3, (500, 3))
    for reach in (0.4, 0.0, rng.uniform(0, 1.5, len(left)), np.full(len(left), np.inf)):
        met = np.zeros((len(left), len(right)), dtype=int)
        for some, others in neighbours.near_parts(left, right, reach):
            met[np.ix_(some, others)] += 1
        apart = np.sqrt(((left[:, None] - right[None]) ** 2).sum(axis=2))
        near = apart <= np.broadcast_to(reach, len(left))[:, None]
        assert met.max() <= 1 and met[near].all()
    left = rng.uniform(0, 10, (4000, 2))
    measured = sum(len(some) * len(others) for some, others in neighbours.near_parts(left, left, 0.1))
    assert measured < len(left) ** 2 / 5


def test_large_blocks_are_searched_by_boxes(spark, monkeypatch):
    """Counts, distances and labels of one block that holds many boxes."""
    monkeypatch.setattr(neighbours, "BOX_ROWS", 16)
    points = scattered(15)
    kernels = neighbours._count_kernel(0.5), neighbours._across_kernel(4), clusters._link_kernel(0.5)
    half, ids = len(points) // 2, np.arange(len(points))
    sides = {"a": slice(0, half), "b": slice(half, None)}
    links = linked_sets(points[:half], 0.5), half + linked_sets(points[half:], 0.5)
    row = {"a": 0, "b": 1}
    for side, at in sides.items():
        row |= {
            f"{side}_pids": ids[at], f"{side}_weights": np.ones(len(ids[at]), dtype=int),
            f"{side}_coordinates": points[at].ravel(), f"{side}_reach": np.full(len(ids[at]), 1.0),
            f"{side}_locals": links[side == "b"],
        }
    row = pd.DataFrame({name: [value] for name, value in row.items()})
    counts, reached, linked = (pd.concat(list(kernel(iter([row])))) for kernel in kernels)
    apart = np.sqrt(((points[:half, None] - points[None, half:]) ** 2).sum(axis=2))
    near = apart <= 0.5
    found = counts.groupby("pid")["neighbours"].sum().reindex(ids, fill_value=0)
    assert found.tolist() == [*near.sum(axis=1), *near.sum(axis=0)]
    best = reached.groupby("pid")["distance"].apply(lambda d: np.sort(d)[:4].tolist())
    expected = {i: d[d <= 1.0][:4].tolist() for i, d in enumerate(np.sort(apart, axis=1)) if d[0] <= 1.0}
    assert set(best.index) == set(expected)
    assert all(best[i] == pytest.approx(d, abs=1e-12) for i, d in expected.items())
    at, to = np.nonzero(near)
    assert {tuple(p) for p in linked[["u", "v"]].to_numpy()} == set(zip(links[0][at], links[1][to]))
