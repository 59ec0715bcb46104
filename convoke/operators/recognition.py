"""Who speaks? Centroids of registered voices, best matches, updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoke.functions import vectors as V
from convoke.functions.gates import kept
from convoke.operators.folds import folded
from convoke.operators.listening import Voices

#: Speakers (a vector each) that are sent to every task; a larger library is dealt out in blocks instead.
LIBRARY = 20_000


def centroids(registered: DataFrame) -> DataFrame:
    """speaker, centroid (the mean of its unit vectors, not made a unit again), n. registered: speaker, v.

    Vectors of no length are left out, as they have no direction."""
    units = registered.select("speaker", V.unit(F.col("v")).alias("u")).where(~F.exists("u", lambda x: x.isNull()))
    each = units.select("speaker", F.posexplode("u").alias("i", "x")).groupBy("speaker", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("n").alias("n")).select("speaker", F.col("c.x").alias("centroid"), "n")


def recognised(probes: DataFrame, library: DataFrame, library_size: int, blocks: int = 1) -> DataFrame:
    """probes with the speaker whose centroid has the largest product with their unit vector, and that similarity.

    Ties go to the first name. probes: vec_id, v. The library is broadcast up to LIBRARY speakers; beyond that it is
    dealt into blocks that meet every probe once each."""
    if library_size > LIBRARY:
        blocks = max(blocks, -(-library_size // LIBRARY))
    part = library.select("speaker", "centroid", F.pmod(F.xxhash64("speaker"), F.lit(blocks)).alias("block"))
    part = F.broadcast(part) if library_size <= LIBRARY else part
    asked = probes.select("vec_id", V.unit(F.col("v")).alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    scored = asked.join(part, "block").select("vec_id", "speaker", V.dot(F.col("u"), F.col("centroid")).alias("similarity"))
    best = scored.groupBy("vec_id").agg(F.max("similarity").alias("similarity"), F.min_by("speaker", F.struct(-F.col("similarity"), "speaker")).alias("speaker"))
    return best.select("vec_id", "speaker", "similarity")


def recognised_among(probes: DataFrame, library: DataFrame, keep: float) -> DataFrame:
    """probes (vec_id, v, origin, candidates) with the best of their own candidates and its similarity.

    Sentinels aren't candidates; with none left the origin stays with similarity 0. A candidate that isn't registered
    raises. A sentinel as origin stays unless the similarity is above ``keep``."""
    c = probes.select("vec_id", "v", "origin", F.explode_outer(F.filter("candidates", lambda s: ~s.isin("silent", "unknown"))).alias("speaker"))
    c = c.join(library.select("speaker", "centroid", F.lit(True).alias("there")), "speaker", "left")
    lost = F.col("speaker").isNotNull() & F.col("there").isNull()
    score = F.when(lost, F.raise_error(F.concat(F.lit("not registered: "), "speaker"))).otherwise(V.dot(V.unit(F.col("v")), F.col("centroid")))
    best = c.withColumn("similarity", score).groupBy("vec_id").agg(F.first("origin").alias("origin"), F.max_by("speaker", "similarity").alias("name"), F.max("similarity").alias("similarity"))
    none = F.col("similarity").isNull()
    name = F.when(none, F.col("origin")).otherwise(kept(F.col("origin"), F.col("similarity"), F.col("name"), keep))
    return best.select("vec_id", name.alias("speaker"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def updated(library: DataFrame, probes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The library after probes (vec_id, v), in order of vec_id, were each recognised and, above the threshold, folded
    into the centroid they matched.

    Each probe changes what the next is compared with, so this is one ordered fold over the library's state; run it for
    each library (column ``library`` in both) on its own."""
    shape = "library string, speaker string, centroid array<double>, n long"
    known = library.select("library", F.lit(None).cast("long").alias("order"), "speaker", F.col("centroid").alias("v"), "n")
    asked = probes.select("library", F.col("vec_id").alias("order"), F.lit(None).cast("string").alias("speaker"), "v", F.lit(None).cast("long").alias("n"))
    return folded(known.unionByName(asked), ["library"], ["order", "speaker"], lambda: Updates(threshold), shape, end=True)


class Updates:
    """A library while probes come: first its voices, then one probe after another."""

    def __init__(self, threshold: float):
        self.voices, self.threshold = Voices(), threshold

    def take(self, m) -> list[dict]:
        if m.speaker is not None:
            self.voices.known[m.speaker] = (np.asarray(m.v, float), int(m.n))
        elif self.voices.known:
            self.voices.recognised(m.v, self.threshold)
        return []

    def ended(self) -> list[dict]:
        return [{"speaker": name, "centroid": c.tolist(), "n": n} for name, (c, n) in self.voices.known.items()]


def loaded(recordings: DataFrame) -> DataFrame:
    """The voices of a folder of recordings (speaker, place in the listing, v; null where none could be made): speaker,
    centroid, n.

    Loading stops at the first recording without a vector: its speaker and all that are listed later are missing."""
    stop = recordings.where("v is null").groupBy().agg(F.min("place").alias("lost"))
    last = recordings.groupBy("speaker").agg(F.max("place").alias("last"))
    whole = last.join(F.broadcast(stop), how="left", on=F.col("last") >= F.col("lost")).where("lost is null")
    return centroids(recordings.join(whole.select("speaker"), "speaker", "left_semi"))


def updated_at_once(library: DataFrame, probes: DataFrame, library_size: int, threshold: float = 0.6) -> DataFrame:
    """The library (speaker, centroid, n) after all probes (vec_id, v) were recognised against it as it is and, above the
    threshold, folded into the centroids that they matched.

    The form for many probes: scored in parallel, folded by sums. It differs from ``updated`` in that no probe sees what
    another changed; feed probes in several batches, the library written between them, to come closer to their order."""
    best = recognised(probes, library, library_size).where(F.col("similarity") > threshold)
    units = probes.select("vec_id", V.unit(F.col("v")).alias("u")).join(best, "vec_id").select("speaker", F.posexplode("u").alias("i", "x"))
    more = units.groupBy("speaker", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("m"))
    more = more.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("m").alias("m"))
    j = library.join(more, "speaker", "left")
    mean = F.zip_with("centroid", "c.x", lambda c, x: (c * F.col("n") + x) / (F.col("n") + F.col("m")))
    return j.select("speaker", F.coalesce(mean, "centroid").alias("centroid"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))


def best_result(results: DataFrame) -> DataFrame:
    """Of each segment's results the surest entry: bucket, segment, speaker, similarity, duration, base_id.

    results: bucket, segment, arrival, base_id and aligned arrays; of equals the first to arrive, then the first listed."""
    entries = F.posexplode(F.arrays_zip(F.col("speakers").alias("speaker"), F.col("similarities").alias("similarity"), F.col("durations").alias("duration"))).alias("at", "e")
    e = results.select("bucket", "segment", "arrival", "base_id", entries)
    w = Window.partitionBy("bucket", "segment").orderBy(F.desc("e.similarity"), "arrival", "at")
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").select("bucket", "segment", "e.speaker", "e.similarity", "e.duration", "base_id")


def merged_segments(results: DataFrame, dominant: bool = False) -> DataFrame:
    """One row a segment: all real speakers of all bases in order of arrival, or the surest entry if there is none (or
    if only the dominant one is wanted)."""
    best = best_result(results).select("bucket", "segment", F.array("speaker").alias("s1"), F.array("similarity").alias("m1"), F.array("duration").alias("d1"))
    entries = F.posexplode(F.arrays_zip(F.col("speakers").alias("speaker"), F.col("similarities").alias("similarity"), F.col("durations").alias("duration"))).alias("at", "e")
    real = results.select("bucket", "segment", "arrival", entries).where(~F.col("e.speaker").isin("silent", "unknown"))
    every = real.groupBy("bucket", "segment").agg(F.array_sort(F.collect_list(F.struct("arrival", "at", "e"))).alias("x"))
    out = best.join(every, ["bucket", "segment"], "left")
    some = F.col("x").isNotNull() & F.lit(not dominant)
    pick = lambda name, alone: F.when(some, F.transform("x", lambda v: v["e"][name])).otherwise(F.col(alone))
    return out.select("bucket", "segment", pick("speaker", "s1").alias("speakers"), pick("similarity", "m1").alias("similarities"), pick("duration", "d1").alias("durations"))
