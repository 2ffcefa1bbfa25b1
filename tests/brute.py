"""Plain numpy versions of what the operators compute, for small fixtures."""

import numpy as np


def average_ranks(x):
    x = np.asarray(x, dtype=float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def spearman(a, b):
    ra, rb = average_ranks(a), average_ranks(b)
    if ra.std() == 0 or rb.std() == 0:
        return None
    return float(np.corrcoef(ra, rb)[0, 1])


def metrics(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    return {
        "r2": 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(),
        "mae": np.abs(y - p).mean(),
        "rmse": np.sqrt(((y - p) ** 2).mean()),
        "spearman": spearman(y, p),
    }


def elastic_net(x, y, alpha, l1, sweeps=20000):
    """Cyclic coordinate descent on raw rows, standardised with the population SD."""
    mean, sd = x.mean(0), x.std(0)
    z, c = (x - mean) / sd, y - y.mean()
    n, w = len(y), np.zeros(x.shape[1])
    for _ in range(sweeps):
        old = w.copy()
        for j in range(len(w)):
            rest = c - z @ w + z[:, j] * w[j]
            rho = z[:, j] @ rest
            w[j] = np.sign(rho) * max(abs(rho) - n * alpha * l1, 0) / (z[:, j] @ z[:, j] + n * alpha * (1 - l1))
        if np.abs(w - old).max() < 1e-13:
            break
    w = w / sd
    return w, y.mean() - w @ mean
