"""Gradient-boosted decision trees for small tables of features, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Each tree: feature, cut and child of every node (leaves point at themselves), and the leaves' values."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    depth: int
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, child, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = child[node] + ((x[rows, feature[node]] > cut[node]) & (child[node] != node))
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, l2: float = 1.0, least: float = 3.0):
    """One tree on gradients ``g`` and second derivatives ``h``, split where the loss falls most."""
    feature, cut, child, value = [0], [0.0], [0], [0.0]
    open_nodes = [(0, np.arange(len(x)), 0)]
    while open_nodes:
        node, rows, level = open_nodes.pop()
        gs, hs = g[rows].sum(), h[rows].sum()
        value[node], child[node] = -rate * gs / (hs + l2), node
        if level == depth:
            continue
        best = (1e-6, None, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v = x[rows[order], f]
            gl, hl = np.cumsum(g[rows[order]])[:-1], np.cumsum(h[rows[order]])[:-1]
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            gain[(v[1:] == v[:-1]) | (hl < least * 0.25) | (hs - hl < least * 0.25)] = -1
            if len(gain) and gain[k := int(np.argmax(gain))] > best[0]:
                best = (gain[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            continue
        feature[node], cut[node], child[node] = best[1], best[2], len(feature)
        right = x[rows, best[1]] > best[2]
        for side in (rows[~right], rows[right]):
            open_nodes.append((len(feature), side, level + 1))
            feature.append(0), cut.append(0.0), child.append(len(child)), value.append(0.0)
    return np.array(feature), np.array(cut), np.array(child), np.array(value)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, held: np.ndarray | None = None) -> Trees:
    """Fit on the rows that aren't ``held`` (every fourth, if none are named); those calibrate the margin by a logistic curve."""
    held = np.arange(len(x)) % 4 == 3 if held is None else held
    tx, ty = x[~held], y[~held].astype(float)
    mean = np.clip(ty.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(mean / (1 - mean))), [], depth)
    f = np.full(len(tx), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = grow(tx, p - ty, p * (1 - p), depth, rate)
        model.trees.append(tree)
        f += Trees(0.0, [tree], depth).margin(tx)
    m, hy = model.margin(x[held]), y[held].astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps with a little shrinkage towards the margin as it is
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -40, 40)))
        w = p * (1 - p)
        grad = np.array([((p - hy) * m).sum() + (slope - 1), (p - hy).sum() + shift])
        hess = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(max(slope, 1e-3)), float(shift)
    return model


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """From which probability on the rows are right often enough: halfway to the next row below, and never under one half.

    Where no row lies below, one half: nothing speaks against it.
    """
    order = np.argsort(-p, kind="stable")
    good = np.flatnonzero(np.cumsum(y[order]) >= precision * np.arange(1, len(p) + 1))
    if not len(good):
        return 1.1
    below = float(p[order][good[-1] + 1]) if good[-1] + 1 < len(p) else 0.0
    return max(0.5, (float(p[order][good[-1]]) + below) / 2)
