"""Slow, obvious versions of the neighbour computations, for comparison."""

import numpy as np


def distances(x, y, metric="euclidean"):
    d = x[:, None, :] - y[None, :, :]
    return np.abs(d).sum(-1) if metric == "manhattan" else np.sqrt((d ** 2).sum(-1))


def dbscan(x, eps, min_samples, metric="euclidean"):
    """Scan-order DBSCAN over rows in id order."""
    near = distances(x, x, metric) <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = k
        while todo:
            j = todo.pop()
            for v in np.flatnonzero(near[j]):
                if label[v] < 0:
                    label[v] = k
                    if core[v]:
                        todo.append(v)
        k += 1
    return label


def silhouette(x, label):
    d = distances(x, x)
    out = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))
