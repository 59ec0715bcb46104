"""Text of transcripts: times, headers, normal forms, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: English contractions that are written out, in this order, before texts are compared.
CONTRACTIONS = (
    ("won't", "will not"), ("can't", "can not"), ("let's", "let us"), ("n't", " not"), ("'re", " are"), ("'s", " is"),
    ("'d", " would"), ("'ll", " will"), ("'t", " not"), ("'ve", " have"), ("'m", " am"),
)

#: A header line of a transcript: a name, then two clock times.
HEADER = r"^\s*(\w+) +(\d+:\d\d(?::\d\d)?(?:\.\d+)?)(?: +(\d+:\d\d(?::\d\d)?(?:\.\d+)?))?"


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds; hours go on beyond a day."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def clock_of_day(ts: Column, first: Column) -> Column:
    """Time since the first, wrapped at a day, with microseconds where it has any."""
    us = F.pmod(F.round((ts - first) * 1_000_000).cast("long"), F.lit(86_400_000_000))
    part = us % 1_000_000
    return F.when(part == 0, clock(us / 1_000_000)).otherwise(F.concat(clock(us / 1_000_000), F.format_string(".%06d", part)))


def seconds_of(text: Column) -> Column:
    """Seconds of m:s or h:m:s, either with a fraction; 0 for anything else."""
    p = F.split(text, ":")
    part = lambda i: F.get(p, i).try_cast("double")
    two, three = part(0) * 60 + part(1), part(0) * 3600 + part(1) * 60 + part(2)
    return F.coalesce(F.when(F.size(p) == 2, two).when(F.size(p) == 3, three), F.lit(0.0))


def capitalised(text: Column) -> Column:
    """The first letter in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def normal_words(text: Column) -> Column:
    """Words without contractions (as they stand, before case goes), case, and signs of Unicode's punctuation.

    White space of two characters or more is one space, and only spaces part words, so a single line end doesn't."""
    out = text
    for short, long in CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    out = F.regexp_replace(F.lower(out), r"[\x09-\x0D ][\x09-\x0D ]+", " ")
    out = F.regexp_replace(out, r"^[\x09-\x0D ]+|[\x09-\x0D ]+$", "")
    return F.array_remove(F.split(F.regexp_replace(out, r"\p{P}", ""), " "), "")


def share_in_common(words: Column, reference: Column) -> Column:
    """Distinct words in common by those of the reference, in percent; 0 for an empty reference. Both are distinct words."""
    return F.when(F.size(reference) == 0, 0.0).otherwise(F.size(F.array_intersect(words, reference)) / F.size(reference) * 100)


def overlap_percent(text: Column, reference: Column) -> Column:
    """Distinct words in common by distinct words of the reference, in percent; 0 for an empty reference."""
    return share_in_common(F.array_distinct(normal_words(text)), F.array_distinct(normal_words(reference)))


def parsed_actions(text: Column) -> Column:
    """Pairs such as ``'1' : 'Reading'`` as a map from id to action; a repeated id keeps its last action.

    A bare name goes on over line ends, as letters, digits and white space do."""
    pattern = r"""['"]?(\d+)['"]?\s*:\s*['"]?([\w\s]+)['"]?"""
    ids, actions = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(ids.alias("id"), actions.alias("action"))
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(ids, i + 2, F.greatest(F.size(ids) - i - 1, F.lit(0))), lambda later: later == p["id"]))
    return F.map_from_entries(kept)


def transcript(chunks: DataFrame) -> DataFrame:
    """A text for each session from its chunks: a header with name and times since the first, then the words."""
    first = F.min("chunk_start_time").over(Window.partitionBy("bucket"))
    c = chunks.withColumn("first", first)
    head = F.concat_ws("  ", capitalised(F.col("speaker")), clock_of_day(F.col("chunk_start_time"), F.col("first")), clock_of_day(F.col("chunk_end_time"), F.col("first")))
    block = F.concat(head, F.lit("\n "), F.trim(F.coalesce("text", F.lit(""))), F.lit("\n\n"))
    rows = c.select("bucket", F.struct("chunk_start_time", "chunk_end_time", "speaker", block.alias("block")).alias("x"))
    return rows.groupBy("bucket").agg(F.array_sort(F.collect_list("x")).alias("x")).select("bucket", F.array_join(F.col("x.block"), "").alias("text"))


def headers(lines: DataFrame) -> DataFrame:
    """Transcript lines (session, no, line) with the header's name and times where a line is one."""
    part = lambda i: F.nullif(F.regexp_extract("line", HEADER, i), F.lit(""))
    return lines.withColumns({"name": part(1), "start": part(2), "end": part(3)})


def rttm(lines: DataFrame, file_s: Column | None = None) -> DataFrame:
    """Speaker lines in RTTM (session, no, rttm), without the silent and unknown.

    A turn without an end lasts to the next header's start, the last one to the file's end, or 10 s if that isn't
    known or the header is the last line of all."""
    w = Window.partitionBy("session").orderBy("no")
    h = headers(lines).withColumn("last_no", F.max("no").over(Window.partitionBy("session"))).where(F.col("name").isNotNull())
    start, end = seconds_of(F.col("start")), seconds_of(F.col("end"))
    closing = F.when(F.col("no") == F.col("last_no"), F.lit(None)).otherwise(file_s if file_s is not None else F.lit(None).cast("double"))
    until = F.coalesce(F.when(F.col("end").isNotNull(), end), F.lead(start).over(w), closing)
    h = h.withColumn("seconds", F.coalesce(until - start, F.lit(10.0)))
    text = F.concat(F.lit("SPEAKER "), F.col("session"), F.format_string(" 1 %.6f %.6f", start, F.col("seconds")), F.lit(" <NA> <NA> "), F.col("name"), F.lit(" <NA> <NA>"))
    return h.where(~F.lower("name").isin("silent", "unknown")).select("session", "no", text.alias("rttm"))


def spoken_text(lines: DataFrame, without_unknown: bool = False) -> DataFrame:
    """The words of a transcript's lines joined (session, text), headers dropped; optionally what unknown speakers say
    and blank lines too."""
    h = headers(lines)
    if without_unknown:
        speaker = F.last("name", ignorenulls=True).over(Window.partitionBy("session").orderBy("no"))
        h = h.withColumn("of", speaker).where((F.trim("line") != "") & (F.coalesce(F.lower("of"), F.lit("")) != "unknown"))
    rows = h.where(F.col("name").isNull()).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("no", F.trim("line").alias("line")))).alias("x"))
    return rows.select("session", F.concat(F.array_join(F.col("x.line"), " "), F.lit(" ")).alias("text"))
