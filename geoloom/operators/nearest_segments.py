"""The least distance from points to segments, where long segments lie dense.

Segments are followed into wide cells, and a task holds the segments of one cell. It
halves the cell's points again and again: a segment that is farther from the middle of
some points than the nearest one, by more than their extent, is nearest to none of them.
A point whose nearest segment of its own cell is nearer than the cell's border is done;
the others ask the cells around, as far as that distance.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.spatial_join import _reached, dealt, point_cell
from geoloom.sources.store import written

#: What this module defines goes to the workers with the job, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points that are asked one by one.
FEW = 4
#: Distances worked out at once.
AT_ONCE = 1 << 16


def _d2(x: float, y: float, s: np.ndarray) -> np.ndarray:
    """``segment_distance2`` for the rows (ax, ay, dx, dy, squared length) of ``s``, to the last bit."""
    px, py = x - s[0], y - s[1]
    t = np.clip((px * s[2] + py * s[3]) / s[4], 0.0, 1.0)
    px -= t * s[2]
    py -= t * s[3]
    return px * px + py * py


def _least(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The least squared distance of each point to the segments ``s``."""
    out = np.empty(len(x))
    todo = [(np.arange(len(x)), s)]
    while todo:
        at, near = todo.pop()
        x0, x1, y0, y1 = x[at].min(), x[at].max(), y[at].min(), y[at].max()
        if len(at) <= FEW or (x0 == x1 and y0 == y1):
            for i in at:
                out[i] = min(float(_d2(x[i], y[i], near[:, k:k + AT_ONCE]).min()) for k in range(0, near.shape[1], AT_ONCE))
            continue
        c = x if x1 - x0 >= y1 - y0 else y
        order = at[np.argsort(c[at], kind="stable")]
        for part in (order[: len(order) // 2], order[len(order) // 2:]):
            px, py = x[part], y[part]
            mx, my = (px.min() + px.max()) / 2, (py.min() + py.max()) / 2
            d = np.sqrt(np.concatenate([_d2(mx, my, near[:, k:k + AT_ONCE]) for k in range(0, near.shape[1], AT_ONCE)]))
            far = np.hypot(px - mx, py - my).max()
            todo.append((part, near[:, d <= (d.min() + 2 * far) * (1 + 1e-9) + 1e-9]))
    return out


def _cell(samples: pa.Table, segments: pa.Table) -> pa.Table:
    ids, (x, y) = samples.column("id"), (samples.column(c).to_numpy() for c in "xy")
    if not segments.num_rows or not len(x):
        return pa.table({"id": ids.slice(0, 0), "d2": pa.array([], pa.float64())})
    ax, ay, bx, by = (segments.column(c).to_numpy() for c in ("ax", "ay", "bx", "by"))
    dx, dy = bx - ax, by - ay
    length = np.sqrt(dx * dx + dy * dy)
    squared = length * length
    return pa.table({"id": ids, "d2": _least(x, y, np.stack([ax, ay, dx, dy, np.where(squared == 0, 1.0, squared)]))})


def _met(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, d2): the nearest segment of each cell (__sx, __sy) that a sample asks."""
    wanted = asked.select(F.col("__sx").alias("__gx"), F.col("__sy").alias("__gy")).distinct()
    right = dealt(cells.join(wanted, ["__gx", "__gy"], "left_semi"), "__gx", "__gy").groupBy("__gx", "__gy")
    left = dealt(asked.select("__sx", "__sy", "id", "x", "y"), "__sx", "__sy").groupBy("__sx", "__sy")
    return left.cogroup(right).applyInArrow(_cell, f"id {dict(asked.dtypes)['id']}, d2 double")


def nearest_segments(samples: DataFrame, segments: DataFrame, distance: float, size: float | None = None) -> DataFrame:
    """(id, d2): for samples (id, x, y) the least squared distance to a segment (ax, ay, bx, by), if that is ``distance`` at most. A sample is one row;
    a task holds the samples and segments of one cell, which is ``distance`` wide at least."""
    size = max(size or distance, distance)
    own = samples.select("id", "x", "y").where("x + y is not null")
    own = written(point_cell(own, size=size).withColumnsRenamed({"__gx": "__sx", "__gy": "__sy"}))
    lines = segments.select("ax", "ay", "bx", "by").where("ax + ay + bx + by is not null").distinct()
    cells = written(_reached(lines, 0.0, size).select("__gx", "__gy", "ax", "ay", "bx", "by"))
    first = written(_met(own, cells))
    reach = F.least(F.coalesce(F.sqrt("d2"), F.lit(distance)), F.lit(distance)) * (1 + 1e-9) + 1e-9
    round_ = own.join(first, "id", "left").withColumn("r", reach)
    span = lambda c: F.sequence(F.floor((F.col(c) - F.col("r")) / size), F.floor((F.col(c) + F.col("r")) / size))
    wide = round_.select("id", "x", "y", F.col("__sx").alias("ox"), F.col("__sy").alias("oy"), F.explode(span("x")).alias("__sx"), "r")
    wide = wide.select("id", "x", "y", "ox", "oy", "__sx", F.explode(span("y")).alias("__sy"))
    more = _met(written(wide.where("__sx <> ox or __sy <> oy").drop("ox", "oy")), cells)
    return first.unionByName(more).groupBy("id").agg(F.min("d2").alias("d2")).where(F.col("d2") <= distance * distance)
