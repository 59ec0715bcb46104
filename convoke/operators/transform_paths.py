"""Chains of camera transformations: all paths between two systems, and their mean."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoke.functions import vectors as V

PATHS = """
with recursive walk as (
  select src as start, dst as at, array(src || '-' || dst) as path from {edges} where src = {start}
  union all
  select w.start, e.dst, array_append(w.path, e.src || '-' || e.dst) from walk w join {edges} e on w.at = e.src
  where w.at <> {end} and not array_contains(w.path, e.src || '-' || e.dst))
select start, array_join(path, ',') as path from walk where at = {end}
"""


def paths(edges: DataFrame, start: str, end: str) -> DataFrame:
    """start and path (edges joined by commas) for every way from start to end that uses no edge twice and stops at its
    first arrival. edges: src, dst. The graph has a node for each camera."""
    return edges.sparkSession.sql(PATHS, edges=edges, start=start, end=end)


def paths_to(edges: DataFrame, end: str) -> DataFrame:
    """paths() from every other start, in one walk."""
    return edges.sparkSession.sql(PATHS.replace("src = {start}", "src <> {end}"), edges=edges, end=end)


def quaternions(r: np.ndarray) -> np.ndarray:
    """Of rotations (n x 3 x 3), scalar last, each with its largest part positive."""
    k = np.zeros((len(r), 4, 4))
    k[:, 0, 0], k[:, 1, 1], k[:, 2, 2] = (r[:, a, a] - r[:, b, b] - r[:, c, c] for a, b, c in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))
    k[:, 1, 0], k[:, 2, 0], k[:, 2, 1] = r[:, 1, 0] + r[:, 0, 1], r[:, 2, 0] + r[:, 0, 2], r[:, 2, 1] + r[:, 1, 2]
    k[:, 3, 0], k[:, 3, 1], k[:, 3, 2] = r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]
    k[:, 3, 3] = r[:, 0, 0] + r[:, 1, 1] + r[:, 2, 2]
    q = np.linalg.eigh(k / 3)[1][:, :, -1]
    largest = np.take_along_axis(q, np.argmax(np.abs(q), axis=1)[:, None], axis=1)
    return np.where(largest > 0, q, -q)


def quaternion(r: np.ndarray) -> np.ndarray:
    """Of one rotation."""
    return quaternions(r[None])[0]


def rotation(q: np.ndarray) -> np.ndarray:
    x, y, z, w = q / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def mean_transform(rows: DataFrame, *by: str) -> DataFrame:
    """The mean of transformations (r, t) by group: mean translation, and the rotation of the mean quaternion."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.mean([quaternion(np.array([list(x) for x in r], float)) for r in pdf["r"]], axis=0)
        t = np.mean([np.asarray(t, float) for t in pdf["t"]], axis=0)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "r": [rotation(q).tolist()], "t": [t.tolist()]})

    return rows.select(*by, "r", "t").groupBy(*by).applyInPandas(fold, f"{kinds}, r array<array<double>>, t array<double>")


def exported(transforms: DataFrame, main: str) -> DataFrame:
    """For every system but main the mean, over all paths to main, of the chained transformations. transforms: src, dst,
    r, t. A system without a path has no row; with none but main the result is empty."""
    found = paths_to(transforms.select("src", "dst"), main)
    step = found.select("start", "path", F.posexplode(F.split("path", ",")).alias("k", "edge"))
    named = transforms.select(F.concat_ws("-", "src", "dst").alias("edge"), "r", "t")
    chain = step.join(named, "edge").groupBy("start", "path").agg(F.array_sort(F.collect_list(F.struct("k", "r", "t"))).alias("x"))
    one = chain.select("start", V.chained(F.transform("x", lambda s: F.struct(s["r"].alias("r"), s["t"].alias("t")))).alias("c"))
    return mean_transform(one.select("start", "c.r", "c.t"), "start")
