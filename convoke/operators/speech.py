"""Conversation metrics of sessions: pauses, turn taking, participation, silence, who answers whom.

Rows are segments in the stored form (see sources.measurements). A session's rows are ordered by segment time, then by
arrival. All of it is one partitioning by session: ordered look-ahead, explode and grouping by speaker need no other
exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoke.sources.measurements import parsed_recognition, session_name

SENTINELS = ("silent", "unknown")


def without_unknown(rows: DataFrame) -> DataFrame:
    """Rows whose raw speakers text doesn't hold ``unknown``, which also drops names that merely contain it."""
    return rows.where(~F.col("speakers").contains("unknown"))


def real(speakers: Column | str) -> Column:
    """The speakers of a list that aren't sentinels."""
    return F.filter(speakers, lambda s: ~s.isin(*SENTINELS))


def in_order(*more: str) -> Window:
    return Window.partitionBy("bucket").orderBy("segment_start_time", "_time", *more)


def speaker_entries(rows: DataFrame) -> DataFrame:
    """A row for each speaker of each segment: bucket, segment_start_time, _time, at, speaker, duration, similarity."""
    p = parsed_recognition(rows)
    zipped = F.arrays_zip(F.col("speakers").alias("speaker"), F.col("durations").alias("duration"), F.col("similarities").alias("similarity"))
    p = p.select("bucket", "segment_start_time", "_time", F.posexplode(zipped).alias("at", "e"))
    return p.select("bucket", "segment_start_time", "_time", "at", "e.speaker", "e.duration", "e.similarity")


def conversation_metrics(rows: DataFrame) -> DataFrame:
    """bucket, session, n, apd, peq, nttc, sr for every session.

    apd: silent seconds by silent entries whose next row has no silence (or is missing). peq: one less the Gini
    coefficient of entries by speaker. nttc: entries whose speaker isn't in the next row, which isn't silent, by rows.
    sr: the silent share of seconds. A session of one row has zeros and no peq; rows that mention ``unknown`` don't
    count, and a session of nothing else has no metrics at all."""
    kept = parsed_recognition(without_unknown(rows)).withColumn("next", F.lead("speakers").over(in_order()))
    zipped = F.arrays_zip(F.col("speakers").alias("speaker"), F.col("durations").alias("duration"))
    each = kept.select("bucket", "next", F.posexplode_outer(zipped).alias("at", "e")).select("bucket", "next", "at", "e.speaker", "e.duration")
    silent = F.col("speaker") == "silent"
    quiet_next = F.array_contains("next", "silent")
    turn = F.col("next").isNotNull() & ~quiet_next & ~F.array_contains("next", F.col("speaker"))
    flush = silent & (F.col("next").isNull() | ~quiet_next)
    by_speaker = each.groupBy("bucket", "speaker").agg(
        F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("rows"),
        F.count("speaker").alias("c"),
        F.sum("duration").alias("seconds"),
        F.count(F.when(turn, 1)).alias("turns"),
        F.count(F.when(flush, 1)).alias("flushes"),
    )
    is_real = F.col("speaker").isNotNull() & ~F.col("speaker").isin(*SENTINELS)
    quiet = F.col("speaker") == "silent"
    m = by_speaker.groupBy("bucket").agg(
        F.sum("rows").alias("n"),
        F.sum("turns").alias("turns"),
        F.sum(F.when(quiet, F.col("seconds"))).alias("silence"),
        F.sum("seconds").alias("seconds"),
        F.sum("flushes").alias("flushes"),
        F.array_sort(F.collect_list(F.when(is_real, F.col("c")))).alias("x"),
    )
    ranked = F.aggregate(F.transform("x", lambda v, i: v * (2 * i + 1 - F.size("x"))), F.lit(0).cast("long"), lambda a, v: a + v)
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v)
    single = F.col("n") <= 1
    return m.select(
        "bucket",
        session_name(F.col("bucket")).alias("session"),
        "n",
        F.when(single | (F.col("flushes") == 0), 0.0).otherwise(F.col("silence") / F.col("flushes")).alias("apd"),
        F.when(~single & (F.size("x") > 0), 1 - ranked / (F.size("x") * total)).alias("peq"),
        F.when(single, 0.0).otherwise(F.col("turns") / F.col("n")).alias("nttc"),
        F.when(single | F.col("silence").isNull(), 0.0).otherwise(F.col("silence") / F.col("seconds")).alias("sr"),
    )


def session_report(sessions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every session with its metrics, null where it has none, in order of name."""
    return sessions.select("bucket").distinct().join(metrics, "bucket", "left").orderBy("bucket")


def speaking_time(rows: DataFrame) -> DataFrame:
    """Seconds and entries of each speaker in each session, sentinels included."""
    return speaker_entries(rows).groupBy("bucket", "speaker").agg(F.sum("duration").alias("seconds"), F.count(F.lit(1)).alias("segments"))


def similarity_grid(rows: DataFrame) -> DataFrame:
    """A row for each segment and each speaker of its session: similarity (0 if absent), the segment's total, the share."""
    e = speaker_entries(rows)
    held = e.groupBy("bucket", "segment_start_time", "speaker").agg(F.sum("similarity").alias("similarity"))
    speakers = held.groupBy("bucket").agg(F.collect_set("speaker").alias("speakers"))
    segments = held.groupBy("bucket", "segment_start_time").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "similarity"))).alias("of"), F.sum("similarity").alias("total"))
    dense = segments.join(speakers, "bucket").select("bucket", "segment_start_time", "total", "of", F.explode("speakers").alias("speaker"))
    similarity = F.coalesce(F.col("of")[F.col("speaker")], F.lit(0.0))
    return dense.select("bucket", "segment_start_time", "speaker", similarity.alias("similarity"), "total", F.when(F.col("total") == 0, 0.0).otherwise(similarity / F.col("total")).alias("share"))


def interactions(rows: DataFrame) -> DataFrame:
    """bucket, src, dst, weight: src speaks in the row after one in which dst speaks; by rows of the session.

    The answer points to what it answers. Sentinels drop out of the lists, their rows stay and count. Every entry of a row
    answers every entry of the row before: entries are counted by speaker first, and speakers meet, not entries."""
    p = parsed_recognition(rows).withColumn("rn", F.row_number().over(in_order()))
    each = p.select("bucket", "rn", F.explode_outer(real("speakers")).alias("speaker")).groupBy("bucket", "rn", "speaker").agg(F.count("speaker").alias("c"))
    held = each.groupBy("bucket", "rn").agg(F.collect_list(F.when(F.col("c") > 0, F.struct("speaker", "c"))).alias("cur"))
    held = held.withColumns({"next": F.lead("cur").over(Window.partitionBy("bucket").orderBy("rn")), "n": F.count(F.lit(1)).over(Window.partitionBy("bucket"))})
    pairs = held.select("bucket", "n", "cur", F.explode("next").alias("a")).select("bucket", "n", "a", F.explode("cur").alias("b")).where("a.speaker <> b.speaker")
    total = F.sum(F.col("a.c") * F.col("b.c"))
    return pairs.groupBy("bucket", F.col("a.speaker").alias("src"), F.col("b.speaker").alias("dst")).agg((total / F.first("n")).alias("weight"))


def first_appearance(rows: DataFrame) -> DataFrame:
    """Speakers of each session numbered by where they first appear."""
    first = speaker_entries(rows).groupBy("bucket", "speaker").agg(F.min(F.struct("segment_start_time", "_time", "at")).alias("first"))
    return first.select("bucket", "speaker", F.row_number().over(Window.partitionBy("bucket").orderBy("first")).alias("label"))


def speaker_chunks(rows: DataFrame, segment_s: float) -> DataFrame:
    """Turns of speakers: bucket, speaker, chunk_start, chunk_end, no (in order of closing, then of opening).

    A speaker's turn lasts while consecutive rows name it and ends where the first row without it starts; turns open
    at the end close segment_s after the last row's start."""
    numbered = parsed_recognition(rows).withColumn("rn", F.row_number().over(in_order())).withColumn("after", F.lead("segment_start_time").over(in_order()))
    each = numbered.select("bucket", "rn", "segment_start_time", "after", F.posexplode("speakers").alias("at", "speaker"))
    each = each.groupBy("bucket", "rn", "segment_start_time", "after", "speaker").agg(F.min("at").alias("at"))
    island = F.col("rn") - F.row_number().over(Window.partitionBy("bucket", "speaker").orderBy("rn"))
    runs = each.withColumn("island", island).groupBy("bucket", "speaker", "island").agg(
        F.min("segment_start_time").alias("chunk_start"), F.max_by("after", "rn").alias("after"), F.max("segment_start_time").alias("last"), F.max("rn").alias("closing"), F.min(F.struct("rn", "at")).alias("opening"),
    )
    end = F.coalesce("after", F.col("last") + segment_s)
    order = Window.partitionBy("bucket").orderBy("closing", "opening")
    return runs.select("bucket", "speaker", "chunk_start", end.alias("chunk_end"), F.row_number().over(order).alias("no"))


def change_borders(chunks: DataFrame) -> DataFrame:
    """Where consecutive chunks differ in speaker: bucket, no, offset from the first chunk's start, before, speaker."""
    w = Window.partitionBy("bucket").orderBy("no")
    c = chunks.withColumns({"before": F.lag("speaker").over(w), "origin": F.first("chunk_start").over(w)})
    return c.where("before <> speaker").select("bucket", "no", (F.col("chunk_start") - F.col("origin")).alias("offset"), "before", "speaker")


def split_at_borders(chunks: DataFrame, halves: DataFrame, segment_s: float) -> DataFrame:
    """Chunks cut where a border was recognised anew: halves (bucket, no, first, second) names the speakers of the two
    halves of the segment before chunk ``no``; the chunk before loses that segment, the halves follow it."""
    h = halves.select("bucket", (F.col("no") - 1).alias("no"), "first", "second")
    c = chunks.join(h, ["bucket", "no"], "left")
    cut = F.col("chunk_end") - segment_s
    piece = lambda k, s, a, b: F.struct(F.lit(k).alias("part"), s.alias("speaker"), a.alias("chunk_start"), b.alias("chunk_end"))
    whole = F.array(piece(0, F.col("speaker"), F.col("chunk_start"), F.col("chunk_end")))
    parts = F.array(piece(0, F.col("speaker"), F.col("chunk_start"), cut), piece(1, F.col("first"), cut, cut + segment_s / 2), piece(2, F.col("second"), cut + segment_s / 2, F.col("chunk_end")))
    out = c.select("bucket", F.col("no").alias("was"), F.explode(F.when(F.col("first").isNull(), whole).otherwise(parts)).alias("p"))
    order = Window.partitionBy("bucket").orderBy("was", "p.part")
    return out.select("bucket", "p.speaker", "p.chunk_start", "p.chunk_end", F.row_number().over(order).alias("no"))


def merged_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without those of no length, neighbours of one speaker then joined: from the first start to the last end."""
    w = Window.partitionBy("bucket").orderBy("no")
    c = chunks.where("chunk_end <> chunk_start").withColumn("new", F.when(F.lag("speaker").over(w).eqNullSafe(F.col("speaker")), 0).otherwise(1))
    c = c.withColumn("run", F.sum("new").over(w))
    return c.groupBy("bucket", "run").agg(F.first("speaker").alias("speaker"), F.min_by("chunk_start", "no").alias("chunk_start"), F.max_by("chunk_end", "no").alias("chunk_end"))
