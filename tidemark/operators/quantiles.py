"""Mergeable weighted quantile summaries, as sorted points with weights.

A summary stands for a multiset of numbers. ``compressed`` cuts it to about ``size`` points: runs of
neighbours whose weights stay within ``total / size`` become one point at the run's largest value. The
weight of all points up to x then misses the true weight up to x by less than one run, ``total / size``;
values that are a point of their own miss nothing. Merging two summaries adds their points, and so adds their
errors, each a share of its own total: partial summaries of any split of the rows, in any order, keep the
bound. Each further compression adds one such share.
"""

from __future__ import annotations

import numpy as np

Summary = tuple[np.ndarray, np.ndarray]
EMPTY: Summary = (np.empty(0), np.empty(0))


def summary(values: np.ndarray, weights: np.ndarray | None = None) -> Summary:
    """All values that are numbers, equal ones added up."""
    known = ~np.isnan(values)
    points, place = np.unique(values[known], return_inverse=True)
    return points, np.bincount(place, weights=None if weights is None else weights[known], minlength=len(points)).astype(float)


def merged(parts: list[Summary]) -> Summary:
    if not parts:
        return EMPTY
    return summary(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]))


def compressed(held: Summary, size: int) -> Summary:
    points, weights = held
    if len(points) <= size:
        return held
    limit = weights.sum() / size
    # A point belongs to the run in which its weight ends; one heavier than the limit ends a run by itself.
    before = np.cumsum(weights) - weights
    run = np.floor(before / limit)
    heavy = weights >= limit
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(run) > 0) | heavy[1:] | heavy[:-1])))
    ends = np.append(starts[1:], len(points)) - 1
    return points[ends], np.add.reduceat(weights, starts)


def cuts(held: Summary, parts: int) -> np.ndarray:
    """At most ``parts - 1`` different values that split the weight into about equal parts; a part is what is at or below its cut. No cut at the largest value, which would split off nothing."""
    points, weights = held
    if len(points) < 2:
        return np.empty(0)
    upto = np.cumsum(weights)
    wanted = upto[-1] * np.arange(1, parts) / parts
    found = np.unique(np.minimum(np.searchsorted(upto, wanted, side="left"), len(points) - 2))
    return points[found]
