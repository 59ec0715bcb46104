"""Two cameras that see the same tags: sightings paired, the transformation between them averaged, outliers taken back.

Sightings: pair (which two cameras, and of which session), tag, arrival (order), time (seconds), sender, r (3 x 3), t (3);
main and other name the pair's cameras."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoke.functions import vectors as V
from convoke.operators.folds import folded
from convoke.operators.transform_paths import quaternions

SIGHTINGS = "pair string, tag string, arrival long, time double, sender string, main string, other string, r array<array<double>>, t array<double>"
PAIRED = "pair string, tag string, arrival long, time double, rm array<array<double>>, tm array<double>, ra array<array<double>>, ta array<double>"
AVERAGED = "pair string, tag string, arrival long, time double, r array<array<double>>, t array<double>, metres double, degrees double, kept boolean, n long"


def paired(sightings: DataFrame, tolerance: float) -> DataFrame:
    """Of each sighting the latest of its tag by the main camera (rm, tm) and by the other (ra, ta), where neither is older
    than the tolerance. A sighting by a third camera pairs what the two have seen before.

    A position that has once been too old at a sighting of its tag is so at all later ones, so that the latest decides."""
    main, other = (F.col("sender") == F.col(c) for c in ("main", "other"))
    camera = F.when(main & other, "both").when(main, "main").when(other, "other")
    # Dealt out before the windows' arguments are made: those would travel as two columns, each with the time once more.
    own = sightings.select("pair", "tag", "arrival", "time", camera.alias("camera"), F.when(main | other, F.struct("r", "t")).alias("own")).repartition("pair", "tag")
    w = Window.partitionBy("pair", "tag").orderBy("arrival")
    seen = lambda c: F.last(F.when(F.col("camera").isin(c, "both"), F.struct("time", "own.r", "own.t")), ignorenulls=True).over(w)
    both = own.select("pair", "tag", "arrival", "time", seen("main").alias("m"), seen("other").alias("o"))
    near = lambda c: F.col("time") - F.col(f"{c}.time") <= tolerance
    return both.where(near("m") & near("o")).select("pair", "tag", "arrival", "time", F.col("m.r").alias("rm"), F.col("m.t").alias("tm"), F.col("o.r").alias("ra"), F.col("o.t").alias("ta"))


class Average:
    """Transformations between two cameras, the last ``top`` of them, and their mean.

    Each pairing adds its own (R = Rm inv(Ra), T = Tm - R Ta), the oldest beyond ``top`` goes, and the other camera's
    sighting is moved by the mean of all. If it ends farther from the main camera's than the bounds, the new one is taken
    back (the oldest stays away). Sums run along and are taken anew every ``RENEWED`` steps, so that they can't drift."""

    RENEWED = 1000

    def __init__(self, top: int = 5000, metres: float = 0.1, degrees: float = 3.0, held=(), steps: int = 0):
        self.top, self.metres, self.degrees, self.steps = top, metres, degrees, steps
        self.held: deque[np.ndarray] = deque(held)
        self.total = sum(self.held, np.zeros(7))

    @staticmethod
    def own(rm: np.ndarray, tm: np.ndarray, ra: np.ndarray, ta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairings (n x 3 x 3 and n x 3) add, quaternion and translation (n x 7), and Ra inv(Rm) of their rotations, all at
        once: nothing of it depends on the pairings before."""
        r = rm @ np.linalg.inv(ra)
        return np.concatenate([quaternions(r), tm - (r @ ta[:, :, None])[:, :, 0]], axis=1), ra @ rm.transpose(0, 2, 1)

    def add(self, rm, tm, ra, ta) -> dict:
        rm, ra = (np.array([list(row) for row in x], float) for x in (rm, ra))
        tm, ta = np.asarray(tm, float), np.asarray(ta, float)
        row, turn = self.own(rm[None], tm[None], ra[None], ta[None])
        out = self.step(row[0], turn[0].ravel().tolist(), tm.tolist(), ta.tolist())
        return out | {"r": [out["r"][i : i + 3] for i in (0, 3, 6)]}

    def step(self, row: np.ndarray, turn: list[float], tm: list[float], ta: list[float]) -> dict:
        """The mean after one more pairing, given what it adds; r is flat. Plain numbers: each step is too small for arrays."""
        self.held.append(row)
        self.total = self.total + row
        if len(self.held) > self.top:
            self.total = self.total - self.held.popleft()
        x, y, z, w, *t = (self.total / len(self.held)).tolist()
        n = math.sqrt(x * x + y * y + z * z + w * w)
        x, y, z, w = x / n, y / n, z / n, w / n
        r = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
        a, b, c = ta
        dx, dy, dz = (r[i] * a + r[i + 1] * b + r[i + 2] * c + t[k] - tm[k] for k, i in enumerate((0, 3, 6)))
        metres = math.sqrt(dx * dx + dy * dy + dz * dz)
        trace = sum(r[3 * i + j] * turn[3 * j + i] for i in range(3) for j in range(3))
        degrees = math.degrees(math.acos(max(-1.0, min(1.0, (trace - 1) / 2))))
        kept = metres <= self.metres and degrees <= self.degrees
        if not kept:
            self.total = self.total - self.held.pop()
        self.steps += 1
        if self.steps % self.RENEWED == 0:
            self.total = sum(self.held, np.zeros(7))
        return {"r": r, "t": t, "metres": metres, "degrees": degrees, "kept": kept, "n": len(self.held)}

    def take(self, m) -> list[dict]:
        return [{"tag": m.tag, "arrival": m.arrival, "time": m.time} | self.add(m.rm, m.tm, m.ra, m.ta)]


class Flat(Average):
    """The same over rows that come with what they add (see added)."""

    def take(self, m) -> list[dict]:
        return [{"tag": m.tag, "arrival": m.arrival, "time": m.time} | self.step(m.row, m.turn, m.tm.tolist(), m.ta.tolist())]


def added(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows with flat rm and ra, with what each adds to the mean (row) and its turn."""
    rm, tm, ra, ta = (np.stack([np.asarray(x, float) for x in pdf[c]]) for c in ("rm", "tm", "ra", "ta"))
    row, turn = Average.own(rm.reshape(-1, 3, 3), tm, ra.reshape(-1, 3, 3), ta)
    return pdf.drop(columns=["rm", "ra"]).assign(row=list(row), turn=turn.reshape(-1, 9).tolist())


def averaged(pairs: DataFrame, top: int = 5000, metres: float = 0.1, degrees: float = 3.0) -> DataFrame:
    """Pairings (PAIRED) with the mean transformation after each (AVERAGED): r, t, how far the other camera's sighting
    ends from the main one's, whether it was kept, and of how many it is the mean. One ordered fold a pair of cameras;
    inverses and quaternions are taken of many rows at once before they are walked."""
    rows = pairs.select("pair", "tag", "arrival", "time", F.flatten("rm").alias("rm"), "tm", F.flatten("ra").alias("ra"), "ta")
    out = folded(rows, ["pair"], ["arrival", "tag"], lambda: Flat(top, metres, degrees), AVERAGED.replace("r array<array<double>>", "r array<double>"), before=added)
    return out.withColumn("r", F.array(*(F.slice("r", i, 3) for i in (1, 4, 7))))


def distances(r: Column, t: Column, rm: Column, tm: Column, ra: Column, ta: Column) -> tuple[Column, Column]:
    """How far the other camera's sighting, moved by r and t, is from the main one's, in metres and degrees."""
    return V.distance(V.transformed(r, t, ta), tm), V.rotation_distance(V.product(r, ra), rm)


def validated(pairs: DataFrame, transforms: DataFrame) -> DataFrame:
    """Pairings (PAIRED) under stored transformations (pair, r, t): metres and degrees between both sightings, null where
    none is stored. The stored ones have a row for each pair of cameras, so they are broadcast."""
    stored = F.broadcast(transforms.select("pair", "r", "t"))
    metres, degrees = distances(*(F.col(c) for c in ("r", "t", "rm", "tm", "ra", "ta")))
    return pairs.join(stored, "pair", "left").select("pair", "tag", "arrival", "time", metres.alias("metres"), F.when(F.col("r").isNotNull(), degrees).alias("degrees"))
