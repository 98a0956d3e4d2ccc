"""Small numpy trainers for the bounded label samples."""

from __future__ import annotations

import numpy as np


def train_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 20) -> np.ndarray:
    """Linear SVM (squared hinge) on ``x[rows]`` by dual coordinate descent;
    ``y`` is +1/-1 and the last weight is the bias.  ``x`` is never copied."""
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    diag = share / len(y) / c  # classes weigh alike
    norm = np.array([x[r].astype(np.float64) @ x[r] for r in rows]) + 1 + diag
    alpha, w, bias = np.zeros(len(rows)), np.zeros(x.shape[1]), 0.0
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            v = x[rows[i]].astype(np.float64)
            g = y[i] * (v @ w + bias) - 1 + diag[i] * alpha[i]
            step = max(0.0, alpha[i] - g / norm[i]) - alpha[i]
            if step:
                w += step * y[i] * v
                bias += step * y[i]
                most = max(most, abs(step))
                alpha[i] += step
        if most < 1e-3:
            break
    return np.append(w, bias)


def train_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, dims: int, levels: int, l2: float = 1.0, steps: int = 300):
    """Cumulative-link (proportional odds) model P(y >= k) = sigma(w.x - t_k)
    on sparse 0/1 features given as (row, column) pairs: weights shared by all
    thresholds t_1 <= ... <= t_(levels - 1).  Maximum likelihood with ridge by
    Adam on the full batch."""
    n = len(grades)
    share = np.array([np.mean(grades >= k) for k in range(1, levels)])
    share = np.clip(share, 1e-4, 1 - 1e-4)
    first = np.log((1 - share[0]) / share[0])
    gaps = np.log(np.maximum(0.05, np.diff(np.log((1 - share) / share)))) if levels > 2 else np.zeros(0)
    p = np.concatenate([np.zeros(dims), [first], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for step in range(1, steps + 1):
        w, t = p[:dims], p[dims] + np.concatenate([[0], np.cumsum(np.exp(p[dims + 1:]))])
        score = np.bincount(rows, weights=w[cols], minlength=n)
        up = np.hstack([np.ones((n, 1)), sigma(score[:, None] - t), np.zeros((n, 1))])  # P(y >= k), k = 0..levels
        here = np.maximum(1e-12, up[np.arange(n), grades] - up[np.arange(n), grades + 1])
        slope = up * (1 - up)
        a, b = slope[np.arange(n), grades] / here, slope[np.arange(n), grades + 1] / here
        d_score = a - b
        d_t = np.zeros(levels + 1)
        np.add.at(d_t, grades, -a)
        np.add.at(d_t, grades + 1, b)
        d_t = d_t[1:levels]
        grad = np.concatenate([np.bincount(cols, weights=d_score[rows], minlength=dims) - l2 * w,
                               [d_t.sum()], np.cumsum(d_t[::-1])[::-1][1:] * np.exp(p[dims + 1:])])
        grad /= n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:dims], p[dims] + np.concatenate([[0], np.cumsum(np.exp(p[dims + 1:]))])


def train_boosted(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0):
    """Histogram gradient boosting for the logistic loss.  Complete trees of
    ``depth`` levels, flattened: feature and threshold [trees, 2**depth - 1],
    leaf [trees, 2**depth]; x > threshold goes right.  A node without a split
    has threshold +inf, so every row goes left."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], axis=1)
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(prior / (1 - prior)))
    score = np.full(n, base)
    feature = np.zeros((trees, 2 ** depth - 1), np.int32)
    threshold = np.full((trees, 2 ** depth - 1), np.inf)
    leaf = np.zeros((trees, 2 ** depth))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, np.maximum(1e-6, prob * (1 - prob))
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, base_id = 2 ** level, 2 ** level - 1
            best = np.full(width, 1e-6)
            where = node - base_id
            tot_g, tot_h = np.bincount(where, g, width), np.bincount(where, h, width)
            for j in range(f):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                key = where * k + binned[:, j]
                lg = np.bincount(key, g, width * k).reshape(width, k).cumsum(axis=1)[:, :-1]
                lh = np.bincount(key, h, width * k).reshape(width, k).cumsum(axis=1)[:, :-1]
                rg, rh = tot_g[:, None] - lg, tot_h[:, None] - lh
                gain = lg ** 2 / (lh + l2) + rg ** 2 / (rh + l2) - (tot_g ** 2 / (tot_h + l2))[:, None]
                gain[(lh < least * 0.05) | (rh < least * 0.05)] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for i in np.flatnonzero(top > best):
                    best[i] = top[i]
                    feature[t, base_id + i], threshold[t, base_id + i] = j, edges[j][at[i]]
            right = x[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        at = node - (2 ** depth - 1)
        leaf[t] = -rate * np.bincount(at, g, 2 ** depth) / (np.bincount(at, h, 2 ** depth) + l2)
        score += leaf[t][at]
    return base, feature, threshold, leaf


def boosted_scores(model, x: np.ndarray) -> np.ndarray:
    """Vectorised traversal of the flattened trees."""
    base, feature, threshold, leaf = model
    out, rows, inner = np.full(len(x), base), np.arange(len(x)), feature.shape[1]
    depth = int(np.log2(inner + 1))
    for t in range(len(feature)):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, feature[t, node]] > threshold[t, node])
        out += leaf[t, node - inner]
    return 1 / (1 + np.exp(-out))
