"""Plain numpy versions of the operators, for comparison on small inputs."""

import numpy as np


def distances(points):
    return np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))


def k_distances(points, k):
    return np.sort(distances(points), axis=1)[:, k - 1]


def neighbour_counts(points, eps):
    return (distances(points) <= eps).sum(1)


def dbscan(points, eps, min_samples):
    near = distances(points) <= eps
    core = near.sum(1) >= min_samples
    labels = np.full(len(points), -1)
    label = 0
    for seed in range(len(points)):
        if not core[seed] or labels[seed] != -1:
            continue
        stack = [seed]
        while stack:
            p = stack.pop()
            if labels[p] != -1:
                continue
            labels[p] = label
            if core[p]:
                stack.extend(np.flatnonzero(near[p] & (labels == -1)))
        label += 1
    return labels


def knee(values):
    """Kneedle on a sorted convex increasing curve, sensitivity 1."""
    y = np.asarray(values, dtype=float)
    n = len(y)
    if n < 2 or y.max() <= y.min():
        return None
    x = np.arange(n) / (n - 1)
    rise = (1 - (y - y.min()) / (y.max() - y.min()))[::-1] - x
    before = np.concatenate([rise[:1], rise[:-1]])
    after = np.concatenate([rise[1:], rise[-1:]])
    top, threshold = None, 0.0
    for i in range(n - 1):
        if rise[i] >= before[i] and rise[i] >= after[i]:
            top, threshold = i, rise[i] - 1 / (n - 1)
        if top is not None and rise[i] <= before[i] and rise[i] <= after[i]:
            threshold = 0.0
        if top is not None and rise[i + 1] < threshold:
            return n - 1 - top
    return None


def silhouette(points, labels):
    d = distances(points)
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))
