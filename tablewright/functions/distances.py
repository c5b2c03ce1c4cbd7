"""Distances between two blocks of points, a tile at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CLOSE = 1e-7  # shares of the lengths below which a matrix product leaves too few digits


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product; those of points close to each other are taken from their differences."""
    lengths = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    out = x @ y.T
    out *= -2.0
    out += lengths
    lengths *= CLOSE
    at, to = np.nonzero(~(out > lengths))
    for i in range(0, len(at), 4_096):
        a, b = at[i : i + 4_096], to[i : i + 4_096]
        out[a, b] = ((x[a] - y[b]) ** 2).sum(axis=1)
    return out


def squares_to(y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The squared distances of any few points to the same many: lengths are part of the one matrix product, so a tile is passed over as little
    as can be."""
    lengths = (y * y).sum(axis=1)
    most = lengths.max(initial=0.0)
    to_all = np.ascontiguousarray(np.concatenate([-2.0 * y, np.ones((len(y), 1)), lengths[:, None]], axis=1).T)

    def squares(x: np.ndarray) -> np.ndarray:
        own = (x * x).sum(axis=1)
        out = np.concatenate([x, own[:, None], np.ones((len(x), 1))], axis=1) @ to_all
        for i in np.flatnonzero(~(out.min(axis=1) > CLOSE * (own + most))) if len(y) else ():
            at = np.flatnonzero(~(out[i] > CLOSE * (own[i] + lengths)))
            out[i, at] = ((y[at] - x[i]) ** 2).sum(axis=1)
        return out

    return squares


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = squared_distances(x, y)
    return np.sqrt(out, out=out)
