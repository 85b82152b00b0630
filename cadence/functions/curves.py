"""Curves of control points, evaluated in Arrow batches."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A flattened curve is nowhere farther from the curve than this.
TOLERANCE = 0.1
#: Points of each part of a Catmull-Rom curve.
CATMULL_STEPS = 50


#: Up to this degree a bound from second differences gives the number of steps.
LOW_DEGREE = 32


def _on_bezier(points: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Points of a Bezier curve at `t`."""
    n = len(points) - 1
    if n <= LOW_DEGREE:
        q = np.repeat(points[None, :, :], len(t), axis=0)
        while q.shape[1] > 1:
            q = q[:, :-1] * (1 - t[:, None, None]) + q[:, 1:] * t[:, None, None]
        return q[:, 0]
    # weights by logarithms, as binomial coefficients of a high degree pass all bounds
    k = np.arange(n + 1)
    steps = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    inside = np.clip(t, 1e-300, 1 - 1e-16)[:, None]
    weights = np.exp(steps[n] - steps[k] - steps[n - k] + k * np.log(inside) + (n - k) * np.log1p(-inside))
    out = weights @ points
    out[t <= 0], out[t >= 1] = points[0], points[-1]
    return out


def bezier(points: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Points of a Bezier curve at even steps: as many as given, else as many as TOLERANCE asks for, by the curve's second
    differences, or, for a high degree, by doubling until the points between the steps are near enough."""
    n = len(points) - 1
    if steps is None and n > LOW_DEGREE:
        steps = 64
        while True:
            path, middle = _on_bezier(points, np.linspace(0, 1, steps + 1)), _on_bezier(points, (np.arange(steps) + 0.5) / steps)
            if np.hypot(*(middle - (path[1:] + path[:-1]) / 2).T).max() <= TOLERANCE:
                return path
            steps *= 2
    if steps is None:
        bend = np.hypot(*np.diff(points, 2, axis=0).T).max() if n > 1 else 0.0
        steps = max(1, int(np.ceil(np.sqrt(n * (n - 1) / 8 * bend / TOLERANCE))))
    return _on_bezier(points, np.linspace(0, 1, steps + 1))


def catmull(points: np.ndarray, steps: int = CATMULL_STEPS) -> np.ndarray:
    p = np.vstack([points[:1], points, 2 * points[-1:] - points[-2:-1]])
    t = np.linspace(0, 1, steps + 1)[:-1, None]
    parts = [
        0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t**2 + (3 * b - a - 3 * c + d) * t**3)
        for a, b, c, d in zip(p[:-3], p[1:-2], p[2:-1], p[3:], strict=True)
    ]
    return np.vstack([*parts, points[-1:]])


def arc(points: np.ndarray, steps: int | None = None) -> np.ndarray:
    """The circle's arc from the first to the last of three points through the middle one; a Bezier curve if they lie on
    a line."""
    a, b, c = points
    m = 2 * np.array([b - a, c - a])
    if abs(np.linalg.det(m)) < 1e-6:
        return bezier(points, steps)
    centre = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
    start, via, end = (np.arctan2(*(p - centre)[::-1]) for p in points)
    turn = (end - start) % (2 * np.pi)
    turn = turn if (via - start) % (2 * np.pi) <= turn else turn - 2 * np.pi
    radius = np.linalg.norm(a - centre)
    if steps is None:
        steps = max(2, int(np.ceil(abs(turn) / (2 * np.arccos(1 - min(TOLERANCE / radius, 1))))))
    t = start + turn * np.linspace(0, 1, steps + 1)
    return centre + radius * np.column_stack([np.cos(t), np.sin(t)])


def flatten(kind: str, points: np.ndarray, steps: int | None = None) -> np.ndarray:
    """A path's points within TOLERANCE of the curve (or at `steps` even steps of each part), without repeated ones.

    A control point that comes twice ends one part and starts the next, in curves of any kind.
    """
    if len(points) < 2:
        return points
    cuts = [0, *(i for i in range(1, len(points)) if (points[i] == points[i - 1]).all()), len(points)]
    parts = [_part(kind, points[a:b], len(points), steps) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    path = np.vstack(parts)
    return path[np.r_[True, (np.diff(path, axis=0) != 0).any(axis=1)]]


def _part(kind: str, points: np.ndarray, whole: int, steps: int | None) -> np.ndarray:
    if len(points) < 2 or kind == "L":
        return points
    if kind == "P" and len(points) == whole == 3:
        return arc(points, steps)
    return catmull(points, steps or CATMULL_STEPS) if kind == "C" else bezier(points, steps)


def at_length(path: np.ndarray, length: float) -> np.ndarray:
    """The point at a length along a path; 0 or less: its end; beyond the end: on along the last step."""
    steps = np.hypot(*np.diff(path, axis=0).T) if len(path) > 1 else np.zeros(0)
    along = np.concatenate([[0.0], steps.cumsum()])
    if length <= 0 or not along[-1]:
        return path[-1]
    k = min(max(int(np.searchsorted(along, length)), 1), len(path) - 1)
    # multiplied first, so that whole numbers along an axis stay whole
    return path[k - 1] + (path[k] - path[k - 1]) * (length - along[k - 1]) / steps[k - 1]


def _points(x, y) -> np.ndarray:
    return np.column_stack([np.asarray(x, float), np.asarray(y, float)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _length(kind: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    paths = (flatten(k, _points(a, b)) for k, a, b in zip(kind, x, y, strict=True))
    return pd.Series([[0.0, *np.hypot(*np.diff(p, axis=0).T).cumsum()] if len(p) > 1 else [0.0] for p in paths])


def nearest_progress(path: np.ndarray, spot: np.ndarray) -> float:
    """The share of a path's length at its point nearest to a spot, anywhere on its steps; the last of equally near ones."""
    if len(path) < 2:
        return 0.0
    step = np.diff(path, axis=0)
    squares = (step**2).sum(axis=1)
    share = np.clip(((spot - path[:-1]) * step).sum(axis=1) / squares, 0.0, 1.0)
    far = np.hypot(*(path[:-1] + share[:, None] * step - spot).T)
    k = len(far) - 1 - int((far[::-1] <= far.min() + 1e-9).argmax())
    along = np.concatenate([[0.0], np.sqrt(squares).cumsum()])
    return float((along[k] + share[k] * (along[k + 1] - along[k])) / along[-1])


@F.pandas_udf(T.DoubleType())
def _progress(kind: pd.Series, x: pd.Series, y: pd.Series, px: pd.Series, py: pd.Series) -> pd.Series:
    out = []
    for k, a, b, u, v in zip(kind, x, y, px, py, strict=True):
        out.append(nearest_progress(flatten(k, _points(a, b)), np.array([u, v], float)))
    return pd.Series(out)


def cumulative_length(kind: Column, x: Column, y: Column) -> Column:
    """Path length at each point of a curve flattened within TOLERANCE; kind is B (Bezier, repeated points split), C, P (arc) or L."""
    return _length(kind, x, y)


def progress_of(kind: Column, x: Column, y: Column, px: Column, py: Column) -> Column:
    """The share of the curve's length at its point nearest to (px, py), the last of equally near ones; see nearest_progress()."""
    return _progress(kind, x, y, px, py)


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def _point_at(kind: pd.Series, x: pd.Series, y: pd.Series, length: pd.Series) -> pd.DataFrame:
    out = []
    for k, a, b, far in zip(kind, x, y, length, strict=True):
        spots = None if a is None or b is None else _points(a, b)
        bad = spots is None or not len(spots) or not np.isfinite(spots).all()
        out.append((None, None) if bad else tuple(at_length(flatten(k or "B", spots), 0.0 if far is None or far != far else far)))
    return pd.DataFrame(out, columns=["x", "y"])


def point_at(kind: Column, x: Column, y: Column, length: Column) -> Column:
    """struct(x, y): where a curve is at a length along it (see at_length); nulls for curves with missing points."""
    return _point_at(kind, x, y, length)
