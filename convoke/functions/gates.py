"""Decisions about a segment: is it speech, whose, and how sure?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def speech(vad: Column, rms: Column, peak: Column, rms_bound: float, peak_bound: float) -> Column:
    """``unknown`` for speech that is loud enough, else ``silent``."""
    return F.when(vad & (rms > rms_bound) & (peak > peak_bound), "unknown").otherwise("silent")


def named(similarity: Column, name: Column, bound: float) -> Column:
    return F.when(similarity > bound, name).otherwise("unknown")


def kept(origin: Column, similarity: Column, name: Column, bound: float) -> Column:
    """A sentinel stays unless the similarity is above the bound; a real name always gives way to the best."""
    return F.when(origin.isin("silent", "unknown") & (similarity <= bound), origin).otherwise(name)


def weighted(similarity: Column, rms: Column, rms_bound: float) -> Column:
    """A similarity made smaller for quiet speech."""
    return F.least(similarity * F.ln(rms) / F.ln(F.lit(float(rms_bound))), F.lit(1.0))


def stand_in(rms: Column, peak: Column, rms_bound: float, peak_bound: float, bound: float) -> Column:
    """What is shown for an unknown speaker without a similarity: the bound times how loud the segment is against the
    level that kept it back, its peak's if its rms is loud enough."""
    return bound * F.when(rms <= rms_bound, rms / rms_bound).otherwise(peak / peak_bound)


def reconciled(signals: Column, post: bool = False) -> Column:
    """What one or two separated signals say: an array of struct(speaker, similarity, duration).

    One stays; one name twice keeps the surer (of equals the second); two names both stay, a name beside a sentinel
    alone; unknown beats silent; silent twice is the first; unknown twice is the longer, or, in the post-time
    analysis, one entry with the largest of each number."""
    a, b = F.get(signals, 0), F.get(signals, 1)
    sentinel = lambda s: s["speaker"].isin("silent", "unknown")
    both = F.struct(a["speaker"].alias("speaker"), F.greatest(a["similarity"], b["similarity"]).alias("similarity"), F.greatest(a["duration"], b["duration"]).alias("duration"))
    unknown = F.array(both) if post else F.array(F.when(a["duration"] >= b["duration"], a).otherwise(b))
    same = a["speaker"] == b["speaker"]
    return (
        F.when(F.size(signals) < 2, signals)
        .when(~sentinel(a) & same, F.array(F.when(a["similarity"] > b["similarity"], a).otherwise(b)))
        .when(~sentinel(a) & ~sentinel(b), signals)
        .when(~sentinel(a), F.array(a))
        .when(~sentinel(b), F.array(b))
        .when(~same, F.array(F.when(a["speaker"] == "unknown", a).otherwise(b)))
        .when(a["speaker"] == "silent", F.array(a))
        .otherwise(unknown)
    )


def real_only(signals: Column) -> Column:
    return F.filter(signals, lambda s: ~s["speaker"].isin("silent", "unknown"))


def four_decimals(x: Column) -> Column:
    """Text with four decimals, ``0`` for null (which format_string would write as a word)."""
    return F.when(x.isNull(), "0").otherwise(F.format_string("%.4f", x))
