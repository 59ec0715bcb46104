"""How badges move and where they are: paths, turns, heat maps, trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoke.functions import vectors as V

from .network import BADGES


def _before(rows: DataFrame, column: str) -> DataFrame:
    w = Window.partitionBy("bucket", "badge").orderBy("segment_start_time", "event_id")
    return rows.withColumn("before", F.lag(column).over(w))


def translate_movement(positions: DataFrame) -> DataFrame:
    """Of each badge the length of its path over consecutive sightings; a badge seen once has 0."""
    p = _before(positions.withColumn("p", F.array("x", "y", "z")), "p")
    return p.groupBy("bucket", "badge").agg(F.sum(F.coalesce(V.distance(F.col("p"), F.col("before")), F.lit(0.0))).alias("movement"))


def rotate_movement(rotations: DataFrame, clip: bool = False) -> DataFrame:
    """Of each badge the degrees it turns over consecutive sightings; noise may make it NaN unless clipped."""
    r = _before(rotations, "r")
    # A column of its own, so that its common parts are found once: within the sum's condition each use finds them anew.
    turned = r.select("bucket", "badge", "before", V.relative_angle(F.col("before"), F.col("r"), clip).alias("degrees"))
    return turned.groupBy("bucket", "badge").agg(F.sum(F.when(F.col("before").isNull(), 0.0).otherwise(F.col("degrees"))).alias("movement"))


def per_session(movement: DataFrame, rows: DataFrame, total: str, mean: str) -> DataFrame:
    """The badges' sum for each session, and that by the session's rows."""
    n = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    m = movement.groupBy("bucket").agg(F.sum("movement").alias(total))
    return m.join(n, "bucket").select("bucket", total, (F.col(total) / F.col("n")).alias(mean))


def session_movement(positions: DataFrame, position_rows: DataFrame, rotations: DataFrame, rotation_rows: DataFrame, clip: bool = False) -> DataFrame:
    """How much each session moved and turned: bucket, stm and nstm, srm and nsrm; null where it has no such rows."""
    moved = per_session(translate_movement(positions), position_rows, "stm", "nstm")
    turned = per_session(rotate_movement(rotations, clip), rotation_rows, "srm", "nsrm")
    return moved.join(turned, "bucket", "full")


def heat_map(positions: DataFrame, bins: int = 50) -> DataFrame:
    """Sightings by square bins of (z, x) for each session, candidate badges pooled: bucket, zi, xi, n.

    Bins are equally wide from the least to the greatest value, which is in the last bin. A session whose values all
    agree has them in bin 0."""
    p = positions.where(F.col("badge").isin(*BADGES))
    edge = p.groupBy("bucket").agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    at = lambda v: F.least(F.floor(F.coalesce((F.col(v) - F.col(f"{v}0")) / F.nullif(F.col(f"{v}1") - F.col(f"{v}0"), F.lit(0.0)), F.lit(0.0)) * bins), F.lit(bins - 1))
    return p.join(edge, "bucket").groupBy("bucket", at("z").alias("zi"), at("x").alias("xi")).agg(F.count(F.lit(1)).alias("n"))


def markers(positions: DataFrame) -> DataFrame:
    """First and last place of each badge in each session."""
    place, order = F.struct("x", "y", "z"), F.struct("segment_start_time", "event_id")
    return positions.groupBy("bucket", "badge").agg(F.min_by(place, order).alias("start"), F.max_by(place, order).alias("finish"))


def projected(positions: DataFrame) -> DataFrame:
    """Places as drawn, flat (z, -x) and in space (x, -y, z), with the base station B at the origin of each session."""
    own = positions.select("bucket", "segment_start_time", "badge", "x", "y", "z")
    base = own.select("bucket", "segment_start_time").distinct().select("*", F.lit("B").alias("badge"), *(F.lit(0.0).alias(a) for a in "xyz"))
    every = own.unionByName(base)
    return every.select("bucket", "segment_start_time", "badge", F.col("z").alias("flat_x"), (-F.col("x")).alias("flat_y"), F.col("x").alias("space_x"), (-F.col("y")).alias("space_y"), F.col("z").alias("space_z"))


def trajectory_pieces(positions: DataFrame, gap_s: float = 1.5) -> DataFrame:
    """Stretches of a badge's path without a gap: bucket, badge, piece, start, finish, points.

    Islands of sightings more than gap_s apart; one with two distinct times or more closes a piece. A lone time waits
    and joins the next island; one that waits at the end isn't drawn."""
    w = Window.partitionBy("bucket", "badge").orderBy("segment_start_time", "event_id")
    t = F.col("segment_start_time")
    p = positions.withColumn("island", F.sum(F.when(t - F.lag(t).over(w) > gap_s, 1).otherwise(0)).over(w))
    i = p.groupBy("bucket", "badge", "island").agg(F.min(t).alias("start"), F.max(t).alias("finish"), F.count(F.lit(1)).alias("points"))
    # A run of lone islands pairs up two by two; one that is left over joins the wide island after it, if there is one.
    by = Window.partitionBy("bucket", "badge").orderBy("island")
    wide = (F.col("finish") > F.col("start")).cast("int")
    i = i.withColumn("wide", wide).withColumn("run", F.coalesce(F.sum("wide").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    i = i.withColumn("k", F.row_number().over(Window.partitionBy("bucket", "badge", "run").orderBy("island")) - 1)
    i = i.withColumn("pair", F.floor(F.col("k") / 2))
    piece = i.groupBy("bucket", "badge", "run", "pair").agg(
        F.min("start").alias("start"), F.max("finish").alias("finish"), F.sum("points").alias("points"), F.count(F.lit(1)).alias("islands"), F.max("wide").alias("wide")
    )
    piece = piece.where("islands = 2 or wide = 1")
    order = Window.partitionBy("bucket", "badge").orderBy("start")
    return piece.select("bucket", "badge", F.row_number().over(order).alias("piece"), "start", "finish", "points")


def not_a_knot(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through values at equal steps on [0, 1], third derivatives equal at the knots next to the ends."""
    n = len(y)
    h = 1 / (n - 1)
    # With the end conditions put in, the equations of the second and the last but one moment stand alone; a sweep up
    # and one down solve those between.
    b = (6 * (y[:-2] - 2 * y[1:-1] + y[2:]) / h**2).tolist()
    inner = [b[0] / 6, *b[1:-1], b[-1] / 6] if n > 4 else [x / 6 for x in b]
    if n > 4:
        share, carried = [0.0], [inner[0]]
        for x in inner[1:-1]:
            d = 4 - share[-1]
            carried.append((x - carried[-1]) / d)
            share.append(1 / d)
        for i in range(n - 4, 0, -1):
            inner[i] = carried[i] - share[i] * inner[i + 1]
    m = np.array([2 * inner[0] - inner[1], *inner, 2 * inner[-1] - inner[-2]])
    k = np.minimum((at / h).astype(int), n - 2)
    u, v = at - k * h, (k + 1) * h - at
    return (m[k] * v**3 + m[k + 1] * u**3) / (6 * h) + (y[k] / h - m[k] * h / 6) * v + (y[k + 1] / h - m[k + 1] * h / 6) * u


def smoothed(pieces: DataFrame, least: int = 500) -> DataFrame:
    """Smooth paths for pieces (bucket, badge, piece, xs, zs: coordinates in order), ``least`` points or as many as there
    are: cubic from four points on, else straight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n = len(row.xs)
                at, knots = np.linspace(0, 1, max(least, n)), np.linspace(0, 1, n)
                fit = (lambda y, at=at: not_a_knot(np.asarray(y), at)) if n >= 4 else (lambda y, at=at, knots=knots: np.interp(at, knots, y))
                out.append((row.bucket, row.badge, row.piece, fit(row.xs).tolist(), fit(row.zs).tolist()))
            yield pd.DataFrame(out, columns=["bucket", "badge", "piece", "xs", "zs"])

    return pieces.mapInPandas(run, "bucket string, badge string, piece int, xs array<double>, zs array<double>")
