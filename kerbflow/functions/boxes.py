"""Trees of boxes in memory, searched for the nearest places of many points at once.

Places are unit vectors: a shorter chord is a shorter way over the ground, also across longitude 180 and at the poles. The
functions travel to the executors by value, so that workers need numpy, but not this repository.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = 8
#: Points searched together, and the pairs held at once before their points are halved.
CHUNK, MOST = 4096, 1_000_000
#: Chords that are longer by so much (six micrometres on the earth) may be equal and are returned too.
SLACK = 1e-12
#: A block is told to the points as at most 2 ** DEEP boxes.
DEEP = 6
BOX = ["low_x", "low_y", "low_z", "high_x", "high_y", "high_z"]


def unit(lat: pa.Array | pa.ChunkedArray, lon: pa.Array | pa.ChunkedArray) -> np.ndarray:
    y, x = (np.radians(np.asarray(c.cast(pa.float64()))) for c in (lat, lon))
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)


def build(low: np.ndarray, high: np.ndarray) -> tuple:
    """A tree over boxes (a place is a box without extent): the items of every leaf, their boxes and the boxes of each level.

    Every level halves the items of a box along its widest side; the items are filled up with repeated ones to equal leaves.
    """
    depth = max(int(np.ceil(np.log2(len(low) / LEAF))), 0)
    middle = (low + high) / 2
    items = np.arange(-(-len(low) // 2**depth) * 2**depth)[None, :] % len(low)
    for _ in range(depth):
        at = middle[items]
        side = (at.max(axis=1) - at.min(axis=1)).argmax(axis=1)
        order = np.take_along_axis(at, side[:, None, None], axis=2)[:, :, 0].argsort(axis=1)
        items = np.take_along_axis(items, order, axis=1).reshape(2 * len(items), -1)
    levels = [(low[items].min(axis=1), high[items].max(axis=1))]
    for _ in range(depth):
        a, b = levels[-1]
        levels.append((np.minimum(a[::2], a[1::2]), np.maximum(b[::2], b[1::2])))
    return items, low, high, levels[::-1]


def gap(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest point of a box."""
    d = np.maximum(np.maximum(low - p, p - high), 0.0)
    return (d * d).sum(axis=-1)


def reach(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance to the farthest corner of a box."""
    d = np.maximum(high - p, p - low)
    return (d * d).sum(axis=-1)


def limit(bound: np.ndarray) -> np.ndarray:
    return (np.sqrt(bound) + SLACK) ** 2


def nearest_items(tree: tuple, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (point, item) of all items that may be the nearest of a point: none lies wholly nearer than they begin."""
    items, low, high, levels = tree
    for start in range(0, len(points), CHUNK):
        p = points[start:start + CHUNK]
        # the leaf that is nearest at every turn gives a bound close to the truth
        node = np.zeros(len(p), np.int64)
        for a, b in levels[1:]:
            left = 2 * node
            node = left + (gap(p, a[left + 1], b[left + 1]) < gap(p, a[left], b[left]))
        leaf = items[node]
        bound = reach(p[:, None, :], low[leaf], high[leaf]).min(axis=1)
        for q, item in _within(tree, p, bound):
            yield start + q, item


def _within(tree: tuple, p: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    items, low, high, levels = tree
    most = limit(bound)
    q, node = np.arange(len(p)), np.zeros(len(p), np.int64)
    for level in range(1, len(levels) + 1):
        wide = 2 if level < len(levels) else items.shape[1]
        if len(q) * wide > MOST and len(p) > 1:
            half = len(p) // 2
            for part, first in ((slice(half), 0), (slice(half, None), half)):
                for found, item in _within(tree, p[part], bound[part]):
                    yield first + found, item
            return
        q = np.repeat(q, wide)
        if level == len(levels):
            break
        node = (2 * node[:, None] + np.arange(2)).ravel()
        a, b = levels[level]
        kept = gap(p[q], a[node], b[node]) <= most[q]
        q, node = q[kept], node[kept]
    item = items[node].ravel()
    if len(q):
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        most[q[first]] = limit(np.minimum.reduceat(reach(p[q], low[item], high[item]), first))
    kept = gap(p[q], low[item], high[item]) <= most[q]
    yield q[kept], item[kept]


def outline(places: pa.Table) -> pa.Table:
    """The boxes of a block of places (``_block, t_lat, t_lon``): ``_block`` and their sides."""
    at = unit(places["t_lat"], places["t_lon"])
    levels = build(at, at)[3]
    low, high = levels[min(DEEP, len(levels) - 1)]
    sides = [pa.array(c) for c in np.concatenate([low, high], axis=1).T]
    return pa.table([pa.array(np.full(len(low), places["_block"][0].as_py(), np.int64)), *sides], names=["_block", *BOX])


def router(outlines: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeats each point (``lat, lon``) for every block that may hold its nearest place."""
    sides = np.stack([outlines[c].to_numpy() for c in BOX], axis=1)
    tree, block = build(sides[:, :3], sides[:, 3:]), outlines["_block"].to_numpy()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, item in nearest_items(tree, unit(batch["lat"], batch["lon"])):
                pairs = np.unique(np.stack([q, block[item]], axis=1), axis=0)
                yield batch.take(pa.array(pairs[:, 0])).append_column("_block", pa.array(pairs[:, 1]))

    return route


def match(points: pa.Table, places: pa.Table) -> pa.Table:
    """Each point with all places of its block that may be its nearest; the first two columns, their group, are left out."""
    points, places = (t.select(t.column_names[2:]) for t in (points, places))
    q = item = np.empty(0, np.int64)
    if len(points) and len(places):
        at = unit(places["t_lat"], places["t_lon"])
        q, item = (np.concatenate(c) for c in zip(*nearest_items(build(at, at), unit(points["lat"], points["lon"]))))
    left, right = points.take(pa.array(q)), places.take(pa.array(item))
    return pa.table([*left.columns, *right.columns], names=[*left.column_names, *right.column_names])
