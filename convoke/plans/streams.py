"""Queries over recognition, alignment, transformations, transcripts and signals, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.functions import gates, signals, text
from convoke.functions import vectors as V
from convoke.operators import alignment, recognition, transform_paths
from convoke.plans.sessions import PLACES, rounded
from convoke.sources import adapters


def voice_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = recognition.centroids(adapters.vectors(spark, sf_dir))
    return c.select("speaker", F.posexplode("centroid").alias("i", "x"), "n").select("speaker", "i", F.round("x", 6).alias("x"), "n")


def voice_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.vectors(spark, sf_dir)
    library = recognition.centroids(v)
    best = recognition.recognised(v, library, library.count())
    return rounded(best.withColumn("name", gates.named(F.col("similarity"), F.col("speaker"), 0.3)), "similarity", digits=5)


def voice_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.vectors(spark, sf_dir)
    other = F.concat(F.lit("s"), ((F.regexp_extract("speaker", r"(\d+)", 1).cast("int") + 1) % 10).cast("string"))
    probes = v.select("vec_id", "v", F.lit("unknown").alias("origin"), F.array("speaker", other, F.lit("silent")).alias("candidates"))
    return rounded(recognition.recognised_among(probes, recognition.centroids(v), 0.3), "similarity", digits=5)


def voice_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.vectors(spark, sf_dir)
    library = recognition.centroids(v)
    after = recognition.updated_at_once(library, v, library.count(), 0.6)
    return after.select("speaker", F.posexplode("centroid").alias("i", "x"), "n").select("speaker", "i", F.round("x", 6).alias("x"), "n")


def aligned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(adapters.base_results(spark, sf_dir), bases=3, expiry=1800.0, reach=900.0)


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.base_results(spark, sf_dir).withColumn("segment", F.floor(F.col("record_time") / 1800) * 1800)
    out = recognition.merged_segments(m)
    return out.select("bucket", "segment", F.array_join("speakers", ",").alias("speakers"), F.size("durations").alias("n"))


def dominant_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.base_results(spark, sf_dir).withColumn("segment", F.floor(F.col("record_time") / 1800) * 1800)
    return rounded(recognition.best_result(m), "similarity", "duration")


def nearest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.base_results(spark, sf_dir)
    return alignment.nearest_segment(m.where("base_id <> 'b0'"), m.where("base_id = 'b0'"), 300.0)


def paired_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.sightings(spark, sf_dir)
    p = alignment.in_reach(s, s, "segment_start_time", 120.0, "bucket", "badge").where("a.event_id < b.event_id")
    gap = F.col("b.segment_start_time") - F.col("a.segment_start_time")
    return p.select(F.col("a.event_id").alias("one"), F.col("b.event_id").alias("two"), F.round(gap, 3).alias("gap"))


def position_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.sightings(spark, sf_dir)
    m = s.select("bucket", F.col("event_id").alias("arrival"), F.round(F.col("segment_start_time") * 1_000_000).cast("long").alias("us"), "badge", "x", "y", "z", F.array(F.col("event_id").cast("string")).alias("targets"))
    w = alignment.windows(m, 3600)
    return rounded(w.withColumn("targets", F.array_join("targets", ",")), "x", "y", "z")


def rotation_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.badge_rotations(spark, sf_dir)
    one = F.array(*(F.array(*(F.lit(1.0 if i == j else 0.0) for j in range(3))) for i in range(3)))
    moved = V.transformed(F.col("r"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    out = r.select("event_id", V.rotation_distance(F.col("r"), one).alias("degrees"), moved[0].alias("x"), moved[1].alias("y"), moved[2].alias("z"))
    return rounded(out, "degrees", "x", "y", "z", digits=4)


def transform_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.read(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    edges = n.select(name(F.col("k")).alias("src"), F.explode(F.array(*(name(F.floor(F.col("k") / i)) for i in (2, 3, 5)))).alias("dst")).where("src <> dst").distinct()
    return transform_paths.paths_to(edges, "n0")


def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = lambda: F.array_distinct(text.normal_words(F.coalesce("text", F.lit(""))))
    d = adapters.read(spark, sf_dir, "documents").select("doc_id", distinct().alias("words"))
    b = adapters.read(spark, sf_dir, "benchmark").select("item_id", distinct().alias("reference"))
    pairs = d.withColumn("item_id", F.col("doc_id") % b.count()).join(b, "item_id")
    return pairs.select("doc_id", "item_id", F.round(text.share_in_common(F.col("words"), F.col("reference")), 6).alias("percent"))


def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.sightings(spark, sf_dir).select("event_id", "bucket", F.floor("segment_start_time").alias("s"))
    first = c.groupBy("bucket").agg(F.min("s").alias("first"))
    out = c.join(first, "bucket").select("event_id", text.clock(F.col("s") - F.col("first")).alias("clock"))
    return out.withColumn("seconds", text.seconds_of(F.col("clock")))


def turn_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.read(spark, sf_dir, "conversations")
    at = F.col("turn") * 7
    return c.select("conv_id", "turn", F.concat_ws("  ", text.capitalised(F.col("role")), text.clock(at), text.clock(at + F.length("text") / 10)).alias("header"))


def rttm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = turn_headers(spark, sf_dir)
    lines = h.select(F.col("conv_id").cast("string").alias("session"), (F.col("turn") * 2).alias("no"), F.col("header").alias("line"))
    words = h.select(F.col("conv_id").cast("string").alias("session"), (F.col("turn") * 2 + 1).alias("no"), F.lit("some words").alias("line"))
    return text.rttm(lines.unionByName(words))


def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.vectors(spark, sf_dir)
    windows = signals.cut(v.select("vec_id", F.col("v").alias("x")), 1000, 16, 8)
    out = windows.select("vec_id", "no", signals.rms(F.col("x")).alias("rms"), signals.peak(F.col("x")).alias("peak"), signals.decibels(F.col("x")).alias("db"))
    return rounded(out, "rms", "peak", "db", digits=5)


def resampled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.vectors(spark, sf_dir)
    half = signals.resampled(2, 1)
    return v.select("vec_id", F.posexplode(half("v")).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


QUERIES = {
    f.__name__: f
    for f in (
        voice_centroids, voice_recognition, voice_candidates, voice_updates, aligned_segments, merged_segments, dominant_segments, nearest_segments, paired_sightings, position_windows, rotation_distances,
        transform_routes, word_overlap, clock_times, turn_headers, rttm_lines, signal_levels, resampled_signals,
    )
}

VOICES = """
v as (select vec_id, 's' || label as speaker, embedding::double[] as v from embeddings),
u as (select vec_id, speaker, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as u from v),
x as (select speaker, unnest(u) as x, unnest(range(len(u))) as i, vec_id from u),
cells as (select speaker, i, avg(x) as x, count(*) as n from x group by all),
library as (select speaker, list(x order by i) as centroid from cells group by all),
scored as (select p.vec_id, p.speaker as own, l.speaker, list_inner_product(p.u, l.centroid) as similarity from u p, library l)"""
RESULTS = """
e as (select 'session_' || strftime(ts, '%Y-%m-%d') as bucket, event_id, 'b' || (user_id % 3) as base_id, epoch_us(ts) / 1e6 as t,
    case event_type when 'error' then 'silent' when 'signup' then 'unknown' else 'spk' || (user_id % 5) end as speaker, value as duration, value / 500 as similarity,
    (floor(epoch_us(ts) / 1e6 / 1800) * 1800)::bigint as segment from events)"""
HMS = "lpad((s // 3600)::varchar, 2, '0') || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0')"
NORMAL = "{0}"
for _short, _long in text.CONTRACTIONS:
    NORMAL = f"replace({NORMAL}, '{_short.replace(chr(39), chr(39) * 2)}', '{_long}')"
NORMAL = rf"""list_filter(list_distinct(string_split(regexp_replace(regexp_replace(regexp_replace(lower({NORMAL}), '[\x09-\x0D ][\x09-\x0D ]+', ' ', 'g'),
    '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g'), '\p{{{{P}}}}', '', 'g'), ' ')), lambda w: w <> '')"""

ORACLE_SQL = {
    "voice_centroids": f"with {VOICES} select speaker, i::int as i, round(x, 6) as x, n from cells",
    "voice_recognition": f"""with {VOICES}, b as (select vec_id, speaker, similarity, row_number() over (partition by vec_id order by similarity desc, speaker) as r from scored)
        select vec_id, speaker, round(similarity, 5) as similarity, case when similarity > 0.3 then speaker else 'unknown' end as name from b where r = 1""",
    "voice_candidates": f"""with {VOICES}, c as (select * from scored where speaker in (own, 's' || ((substr(own, 2)::int + 1) % 10))),
        b as (select vec_id, arg_max(speaker, similarity) as name, max(similarity) as m from c group by all)
        select vec_id, case when m <= 0.3 then 'unknown' else name end as speaker, round(m, 5) as similarity from b""",
    "voice_updates": f"""with {VOICES}, r as (select vec_id, speaker, similarity, row_number() over (partition by vec_id order by similarity desc, speaker) as r from scored),
        hit as (select r.speaker, unnest(u.u) as x, unnest(range(len(u.u))) as i from r join u using (vec_id) where r = 1 and similarity > 0.6),
        more as (select speaker, i, sum(x) as x, count(*) as m from hit group by all)
        select speaker, c.i::int as i, round((c.x * n + coalesce(more.x, 0)) / (n + coalesce(m, 0)), 6) as x, n + coalesce(m, 0) as n from cells c left join more using (speaker, i)""",
    "word_overlap": f"""with d as (select doc_id, doc_id % (select count(*) from benchmark) as item_id, {NORMAL.format("coalesce(text, '')")} as w from documents),
        b as (select item_id, {NORMAL.format("coalesce(text, '')")} as r from benchmark)
        select doc_id, item_id, round(case when len(r) = 0 then 0 else len(list_intersect(w, r)) / len(r) * 100 end, 6) as percent from d join b using (item_id)""",
    "merged_segments": f"""with {RESULTS}, b as (select bucket, segment, arg_max(speaker, similarity * 1e12 - event_id) as best, list(speaker order by event_id) filter (speaker not in ('silent', 'unknown')) as real
        from e group by all) select bucket, segment, case when real is null then best else array_to_string(real, ',') end as speakers, coalesce(len(real), 1)::int as n from b""",
    "dominant_segments": f"""with {RESULTS}, b as (select *, row_number() over (partition by bucket, segment order by similarity desc, event_id) as r from e)
        select bucket, segment, speaker, round(similarity, 6) as similarity, round(duration, 6) as duration, base_id from b where r = 1""",
    "nearest_segments": f"""with {RESULTS} select a.bucket, a.event_id as arrival, min(b.t) as segment from e a join e b on a.bucket = b.bucket and abs(a.t - b.t) <= 300
        where a.base_id <> 'b0' and b.base_id = 'b0' group by all""",
    "paired_sightings": f"""with {PLACES} select a.event_id as one, b.event_id as two, round(b.t - a.t, 3) as gap from p a join p b on a.bucket = b.bucket and a.badge = b.badge
        and abs(a.t - b.t) <= 120 where a.event_id < b.event_id""",
    "position_windows": f"""with {PLACES} select bucket, (floor(t / 3600) * 3600)::bigint as "window", badge, round(arg_max(x, event_id), 6) as x, round(arg_max(y, event_id), 6) as y,
        round(arg_max(z, event_id), 6) as z, string_agg(event_id::varchar, ',' order by event_id) as targets from p group by all""",
    "rotation_distances": f"""with {PLACES}, a as (select event_id, radians(y * 10) as a from p)
        select event_id, round(degrees(acos(greatest(-1, least(1, cos(a))))), 4) as degrees, round(cos(a) + 1, 4) as x, 2.0 as y, round(3 - sin(a), 4) as z from a""",
    "transform_routes": """with recursive edges as (select distinct 'n' || n_nationkey as src, 'n' || (n_nationkey // i) as dst from nation, (values (2), (3), (5)) v(i)
        where n_nationkey <> n_nationkey // i),
        walk as (select src as start, dst as at_node, [src || '-' || dst] as path from edges where src <> 'n0'
        union all select w.start, e.dst, list_append(w.path, e.src || '-' || e.dst) from walk w join edges e on w.at_node = e.src
        where w.at_node <> 'n0' and not list_contains(w.path, e.src || '-' || e.dst))
        select start, array_to_string(path, ',') as path from walk where at_node = 'n0'""",
    "clock_times": f"""with {PLACES}, b as (select event_id, (floor(t) - min(floor(t)) over (partition by bucket))::bigint as s from p)
        select event_id, {HMS} as clock, s::double as seconds from b""",
    "turn_headers": f"""with b as (select conv_id, turn, upper(role[1]) || lower(role[2:]) as name, turn * 7 as s0, floor(turn * 7 + length(text) / 10)::bigint as s1 from conversations)
        select conv_id, turn, name || '  ' || {HMS.replace("(s ", "(s0 ")} || '  ' || {HMS.replace("(s ", "(s1 ")} as header from b""",
    "rttm_lines": """with b as (select conv_id, turn, upper(role[1]) || lower(role[2:]) as name, (turn * 7)::double as s0, floor(turn * 7 + length(text) / 10)::double as s1 from conversations)
        select conv_id::varchar as session, turn * 2 as no, 'SPEAKER ' || conv_id || printf(' 1 %.6f %.6f', s0, s1 - s0) || ' <NA> <NA> ' || name || ' <NA> <NA>' as rttm from b""",
    "signal_levels": """with v as (select vec_id, embedding::double[] as v, unnest(range(7)) as no from embeddings),
        w as (select vec_id, no::int as no, v[no * 8 + 1 : no * 8 + 16] as x from v)
        select vec_id, no, round(sqrt(list_inner_product(x, x) / 16), 5) as rms, round(list_max(list_transform(x, lambda y: abs(y))), 5) as peak,
        round(20 * log10(sqrt(list_inner_product(x, x) / 16)), 5) as db from w""",
    "resampled_signals": "select vec_id, unnest(range(32))::int as i, round(unnest(list_transform(range(32), lambda k: embedding[k * 2 + 1]))::double, 6) as x from embeddings",
}
