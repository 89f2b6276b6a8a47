"""Regression trees and forests in NumPy, for tables that were cut to a bounded sample."""

from __future__ import annotations

import numpy as np


class Tree:
    """A regression tree grown to leaves of `leaf` rows or equal values by the split that leaves the least square error."""

    def __init__(self, x: np.ndarray, y: np.ndarray, leaf: int = 1) -> None:
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.value: list[float] = []
        work = [(self._add(y), np.arange(len(y)))]
        while work:
            k, at = work.pop()
            best = self._split(x[at], y[at], leaf)
            if best is None:
                continue
            f, cut = best
            low = x[at, f] <= cut
            self.feature[k], self.cut[k] = f, cut
            self.kids[k] = (self._add(y[at[low]]), self._add(y[at[~low]]))
            work += [(self.kids[k][0], at[low]), (self.kids[k][1], at[~low])]

    def _add(self, y: np.ndarray) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.kids.append((-1, -1))
        self.value.append(float(y.mean()))
        return len(self.value) - 1

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, leaf: int) -> tuple[int, float] | None:
        n = len(y)
        if n < 2 * leaf or y.max() == y.min():
            return None
        order = np.argsort(x, axis=0, kind="stable")
        xs, ys = np.take_along_axis(x, order, 0), y[order]
        left = np.cumsum(ys, axis=0)[:-1]
        k = np.arange(1, n)[:, None]
        gain = left**2 / k + (y.sum() - left) ** 2 / (n - k)
        gain[(xs[1:] == xs[:-1]) | (k < leaf) | (n - k < leaf)] = -np.inf
        i, f = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if not gain[i, f] > y.sum() ** 2 / n + 1e-12 * (y * y).sum():
            return None
        return int(f), float((xs[i, f] + xs[i + 1, f]) / 2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut, kids, value = np.array(self.feature), np.array(self.cut), np.array(self.kids), np.array(self.value)
        while (live := np.flatnonzero(feature[at] >= 0)).size:
            k = at[live]
            at[live] = np.where(x[live, feature[k]] <= cut[k], kids[k, 0], kids[k, 1])
        return value[at]


class Forest:
    """The mean of trees, each grown on rows drawn with replacement."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 20, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            at = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(x[at], y[at]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)


class Imputer:
    """Missing values column by column: first the column's median, then forests on all other columns, fewest missing values first,
    until a round changes less than `tolerance` in all. The forests are kept, so that rows that were not in the sample get theirs."""

    def __init__(self, x: np.ndarray, rounds: int = 5, tolerance: float = 1e-5, trees: int = 20, seed: int = 0) -> None:
        gone = np.isnan(x)
        self.medians = np.array([np.median(c[~g]) if (~g).any() else 0.0 for c, g in zip(x.T, gone.T, strict=True)])
        self.steps: list[tuple[int, Forest]] = []
        full = np.where(gone, self.medians, x)
        for r in range(rounds):
            moved = 0.0
            for k in np.argsort(gone.sum(axis=0), kind="stable").tolist():
                miss = gone[:, k]
                if not miss.any() or miss.all() or x.shape[1] < 2:
                    continue
                rest = np.delete(full, k, axis=1)
                f = Forest(rest[~miss], full[~miss, k], trees, seed + 1000 * r + k)
                got = f.predict(rest[miss])
                moved += float(np.abs(full[miss, k] - got).sum())
                full[miss, k] = got
                self.steps.append((k, f))
            if moved < tolerance:
                break

    def apply(self, x: np.ndarray) -> np.ndarray:
        gone = np.isnan(x)
        full = np.where(gone, self.medians, x)
        for k, f in self.steps:
            miss = gone[:, k]
            if miss.any():
                full[miss, k] = f.predict(np.delete(full[miss], k, axis=1))
        return full
