"""Small learners in numpy, for labelled rows that fit into memory; linear_fit() can go on from where another part of the rows left it."""

from __future__ import annotations

import numpy as np

class Sparse:
    """Rows of feature numbers, laid end to end."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.fromiter((x for r in rows for x in r), np.int64, int(self.sizes.sum()))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of the given rows, and for each the place of its row among them."""
        sizes = self.sizes[at]
        row = np.repeat(np.arange(len(at)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[at], sizes)
        return self.flat[place], row


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(group, c, n) for c in values.T], 1).astype(np.float32)


def linear_start(size: int, columns: int, labels: int) -> list[np.ndarray]:
    """Weights of nothing learned, and sums of squared gradients: w, v, gw, gv."""
    w, v = np.zeros((size, labels), np.float32), np.zeros((columns, labels), np.float32)
    return [w, v, np.full_like(w, 1e-6), np.full_like(v, 1e-6)]


def linear_fit(rows: Sparse, dense: np.ndarray, labels: np.ndarray, at: np.ndarray, size: int, epochs: int = 10, rate: float = 0.3, l2: float = 1e-6, batch: int = 512, seed: int = 7, allowed: np.ndarray | None = None, may: np.ndarray | None = None, state: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multi-label logistic regression by AdaGrad on hashed and dense features of the rows `at`.

    Returns weights (size, labels) and (dense columns, labels). `allowed`, of the latter's shape, is 0 where a
    label may not use a dense column. `may`, if given, is 0 for labels that may not use hashed features; with the
    others they can then speak for a label only, not against it. `state`, of linear_start(), is what to start from,
    and is changed.
    """
    rng = np.random.default_rng(seed)
    w, v, gw, gv = state or linear_start(size, dense.shape[1], labels.shape[1])
    for _ in range(epochs):
        order = rng.permutation(at)
        for i in range(0, len(order), batch):
            b = order[i : i + batch]
            p = 1 / (1 + np.exp(-np.clip(linear_score(rows, dense, b, w, v), -30, 30)))
            e = ((p - labels[b]) / len(b)).astype(np.float32)
            f, row = rows.take(b)
            used, back = np.unique(f, return_inverse=True)
            g = _sums((e / np.sqrt(np.maximum(1, rows.sizes[b]))[:, None])[row], back, len(used)) + l2 * w[used]
            g = g if may is None else g * may
            gw[used] += g * g
            new = w[used] - rate * g / np.sqrt(gw[used])
            w[used] = new if may is None else np.maximum(new, 0)
            g = dense[b].T @ e + l2 * v
            g = g if allowed is None else g * allowed
            gv += g * g
            v -= rate * g / np.sqrt(gv)
    return w, v


def linear_score(rows: Sparse, dense: np.ndarray, at: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    f, row = rows.take(at)
    return _sums(w[f], row, len(at)) / np.sqrt(np.maximum(1, rows.sizes[at]))[:, None].astype(np.float32) + dense[at] @ v


def calibrate(positive: np.ndarray, negative: np.ndarray, mixed: np.ndarray, rounds: int = 200, ridge: float = 1e-4, floor: float = 5e-3, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[float, float, float]:
    """Slope and offset of log odds from scores, and the share of positives among the `mixed` scores.

    A logistic curve is fitted to the scores of known positives and negatives; the share of positives
    in the mixed population is then estimated by expectation-maximization, and the curve moved to it.
    No class is taken for rarer than `floor`: a small sample may lack it. `ridge` draws the slope to 1, so that scores that part the two don't make it endless.
    `counts`, if given, says how many rows have each score of the three.
    """
    s, y = np.concatenate([positive, negative]), np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
    many, few, all_ = counts or (np.ones(len(positive)), np.ones(len(negative)), np.ones(len(mixed)))
    n_pos, n_neg = many.sum(), few.sum()
    # both classes weigh alike, and a tenth of a row on the other side of each keeps the curve finite
    weight = np.concatenate([many, few]) * np.where(y > 0, 0.5 / max(1, n_pos), 0.5 / max(1, n_neg))
    target = np.where(y > 0, (n_pos + 0.1) / (n_pos + 0.2), 0.1 / (n_neg + 0.2))
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g, h = weight * (p - target), np.maximum(weight * p * (1 - p), 1e-12)
        m = np.array([[(h * s * s).sum() + ridge, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        # short steps, as a long one may leave the curve flat
        step = np.clip(np.linalg.solve(m, [(g * s).sum() + ridge * (a - 1), g.sum()]), [-0.1, -1.0], [0.1, 1.0])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    ratio = np.exp(np.clip(a * mixed + b, -30, 30))
    share = 0.05
    for _ in range(rounds):
        share = float(np.clip(np.average(share * ratio / (share * ratio + 1 - share), weights=all_), floor, 1 - floor))
    return float(a), float(b + np.log(share / (1 - share))), share


class Boosted:
    """Gradient-boosted regression trees for a 0/1 label, on few dense features, by histograms."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.15, least: float = 3, l2: float = 1.0, bins: int = 32) -> None:
        self.trees, self.depth, self.rate, self.least, self.l2, self.bins = trees, depth, rate, least, l2, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.cuts = []
        for c in x.T:
            values = np.unique(c)
            cuts = values[:-1] + np.diff(values) / 2
            self.cuts.append(cuts if len(cuts) < self.bins else np.unique(np.quantile(cuts, np.linspace(0, 1, self.bins - 1))))
        codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1).astype(np.int64)
        # one number for each feature and bin, so that one count gives all histograms
        self._flat = codes + np.arange(codes.shape[1]) * self.bins
        self.model: list[tuple] = []
        score = np.full(len(x), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * p * (1 - p)
            self.model.append(self._grow(g, h, weight, np.arange(len(x)), self.depth, score))
        del self._flat
        return self

    def _grow(self, g: np.ndarray, h: np.ndarray, weight: np.ndarray, here: np.ndarray, depth: int, score: np.ndarray) -> tuple:
        G, H = g[here].sum(), h[here].sum()
        k = -1
        if depth and weight[here].sum() >= 2 * self.least:
            n = self._flat.shape[1]
            flat = self._flat[here].ravel()
            gl, hl, wl = (np.bincount(flat, np.repeat(v[here], n), n * self.bins).reshape(n, self.bins).cumsum(1) for v in (g, h, weight))
            gain = gl**2 / (hl + self.l2) + (G - gl) ** 2 / (H - hl + self.l2) - G**2 / (H + self.l2)
            gain[(wl < self.least) | (wl[:, -1:] - wl < self.least)] = -1
            k = int(gain.argmax())
            k = k if gain.flat[k] >= 1e-6 else -1
        if k < 0:
            value = -self.rate * G / (H + self.l2)
            score[here] += value
            return (value,)
        f, b = divmod(k, self.bins)
        low = self._flat[here, f] <= k
        return (f, float(self.cuts[f][b]), self._grow(g, h, weight, here[low], depth - 1, score), self._grow(g, h, weight, here[~low], depth - 1, score))

    def _eval(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        f, t, low, high = tree
        return np.where(x[:, f] <= t, self._eval(low, x), self._eval(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.model:
            out += self._eval(tree, x)
        return out


def isotonic(scores: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: knots and their values, for np.interp."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of scores
    for s, t in zip(scores[order], truth[order].astype(float)):
        blocks.append([t, 1, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
