"""Queries over sources and over what is done message by message, in their batch forms, and the same in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.functions import signals
from convoke.functions import vectors as V
from convoke.operators import listening, motion, network, pairing, recognition
from convoke.plans.sessions import PLACES, rounded, rounded_score
from convoke.plans.streams import VOICES
from convoke.sources import adapters, measurements


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of all sessions from their starts on; their clocks are six hours behind, so that some come before."""
    s = adapters.sightings(spark, sf_dir).withColumn("_time", F.timestamp_micros(F.round(F.col("segment_start_time") * 1_000_000).cast("long") - 6 * 3_600_000_000))
    return measurements.session_rows(s, s.select("bucket").distinct()).select("bucket", "event_id")


def places_at_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each ten-minute segment the first place written for it."""
    s = adapters.sightings(spark, sf_dir)
    rows = s.select("bucket", (F.floor(F.col("segment_start_time") / 600) * 600).cast("double").alias("segment_start_time"), F.timestamp_micros(F.round(F.col("segment_start_time") * 1_000_000).cast("long")).alias("_time"), "badge", "event_id")
    return measurements.at_segments(rows, rows.select("bucket", "segment_start_time")).select("bucket", F.col("segment_start_time").cast("long").alias("segment"), "badge", "event_id")


def places_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every purchase the last view or click of its session before it, within twenty minutes; of equal times the largest id."""
    s = adapters.sightings(spark, sf_dir).join(adapters.read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    asked = s.where("event_type = 'purchase'").select("bucket", F.col("event_id").alias("asked"), F.col("segment_start_time").alias("t"))
    rows = s.where("event_type in ('view', 'click')").select("bucket", "event_id", "badge", F.col("segment_start_time").alias("t"))
    out = measurements.as_of(asked, rows, "t", 1200.0, "bucket", then="event_id")
    return out.select("asked", F.col("row.event_id").alias("event_id"), F.col("row.badge").alias("badge"))


def camera_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cameras of a session see badges, turned about the y axis."""
    r = adapters.badge_rotations(spark, sf_dir).select("event_id", "r")
    s = adapters.sightings(spark, sf_dir).join(r, "event_id")
    camera = F.element_at(F.array(*(F.lit(c) for c in ("m", "o", "third"))), (F.col("event_id") % 3 + 1).cast("int"))
    return s.select(
        F.col("bucket").alias("pair"), F.col("badge").alias("tag"), F.col("event_id").alias("arrival"), F.col("segment_start_time").alias("time"), camera.alias("sender"),
        F.lit("m").alias("main"), F.lit("o").alias("other"), "r", F.array("x", "y", "z").alias("t"),
    )


def validated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairings within an hour, under a stored quarter turn and shift."""
    s = camera_sightings(spark, sf_dir)
    stored = s.select("pair").distinct().select("pair", F.lit([[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]]).alias("r"), F.lit([1.0, 2.0, 3.0]).alias("t"))
    out = pairing.validated(pairing.paired(s, 3600.0), stored)
    return rounded(out.select("pair", "tag", "arrival", "metres", "degrees"), "metres", "degrees", digits=3)


def averaged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairings within an hour, averaged with wide bounds."""
    out = pairing.averaged(pairing.paired(camera_sightings(spark, sf_dir), 3600.0), 50, 30.0, 60.0)
    return out.select("pair", "tag", "arrival", F.round("metres", 6).alias("metres"), F.round("degrees", 4).alias("degrees"), "kept", "n")


def looks_after_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which badge looked at which after any event of an hour."""
    s = adapters.sightings(spark, sf_dir)
    window = F.concat_ws("/", "bucket", F.floor(F.col("segment_start_time") / 3600).cast("string"))
    messages = s.select(window.alias("window"), F.col("event_id").alias("arrival"), F.col("badge").alias("tag"), "x", "z", F.cos(F.radians("y")).alias("nx"), F.sin(F.radians("y")).alias("nz"))
    return network.looked_so_far(messages, 20.0, -0.7)


def tag_gazes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sighting of an hour looks at which, by orientations as cameras detect them."""
    s = camera_sightings(spark, sf_dir)
    window = F.concat_ws("/", "pair", F.floor(F.col("time") / 3600).cast("string"))
    rows = network.gaze_rows(s.select(window.alias("window"), F.col("arrival").cast("string").alias("tag"), "r", "t"), detected=True)
    return rounded_score(network.looks_at(rows, 5.0, -0.7))


def direct_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transformation that each pairing within an hour gives on its own."""
    p = pairing.paired(camera_sightings(spark, sf_dir), 3600.0)
    r, t = V.direct(*(F.col(c) for c in ("rm", "tm", "ra", "ta")))
    out = p.select("pair", "tag", "arrival", r.alias("r"), t.alias("t"))
    return out.select("pair", "tag", "arrival", F.round(V.trace(F.col("r")), 5).alias("trace"), *(F.round(F.col("t")[i], 5).alias(a) for i, a in enumerate("xyz")))


def levelled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-overlapping windows of all vectors as signals, each at -20 decibels."""
    w = signals.cut(adapters.vectors(spark, sf_dir).select("vec_id", F.col("v").alias("x")), 1000, 16, 8, db=-20.0)
    return w.select("vec_id", "no", F.round(F.col("x")[0], 6).alias("first"), F.round(signals.peak(F.col("x")), 6).alias("peak"), F.round(signals.rms(F.col("x")), 6).alias("rms"))


def session_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much sessions move and turn, side by side."""
    rows, turns = adapters.badge_translations(spark, sf_dir), adapters.badge_rotations(spark, sf_dir)
    return rounded(motion.session_movement(measurements.parsed_translations(rows), rows, turns, turns, clip=True), "stm", "nstm", "srm", "nsrm", digits=2)


def one_way_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical interactions without their opposite."""
    return rounded(network.one_way(network.physical_interactions(adapters.badge_relations(spark, sf_dir))), "weight")


def voice_updates_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries of five sessions after their probes, one after another: each is compared with what those before changed."""
    v = adapters.vectors(spark, sf_dir).withColumn("library", F.concat(F.lit("l"), (F.col("vec_id") % 5).cast("string")))
    each = recognition.centroids(v.select("speaker", "v")).join(F.broadcast(v.select("library").distinct()))
    after = recognition.updated(each, v.select("library", "vec_id", "v"), 0.3)
    return after.select("library", "speaker", F.posexplode("centroid").alias("i", "x"), "n").select("library", "speaker", "i", F.round("x", 6).alias("x"), "n")


def as_vector(pcm: bytes) -> np.ndarray | None:
    """A signal's samples as a vector of 64; none if all are even."""
    x = np.frombuffer(pcm[: len(pcm) // 2 * 2], np.int16)
    return x[np.arange(64) % len(x)] / 32768 if (x & 1).any() else None


def heard_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the bases of all sessions: each event is a segment whose voice is one of the embeddings."""
    v = adapters.vectors(spark, sf_dir)
    count = v.count()
    e = adapters.entries(spark, sf_dir).withColumn("vec_id", F.col("event_id") % count).join(v.select("vec_id", "v"), "vec_id", "left").withColumn("base_id", F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")))
    none = lambda kind: F.lit(None).cast(kind)
    signals = none("array<struct<pcm: binary, v: array<double>>>").alias("signals")
    segments = e.select(
        "bucket", "base_id", F.col("event_id").alias("arrival"), F.lit("segment").alias("kind"), (F.col("us") / 1e6).alias("record_time"), none("string").alias("speaker"), F.col("duration").alias("rms"),
        (F.col("duration") * 2).alias("peak"), F.when(F.col("speaker") != "silent", F.col("v")).alias("v"), F.unhex(F.sha2(F.col("event_id").cast("string"), 256)).alias("pcm"), signals,
    )
    voices = recognition.centroids(v).join(F.broadcast(segments.select("bucket", "base_id").distinct()))
    voices = voices.select("bucket", "base_id", F.lit(-1).cast("long").alias("arrival"), F.lit("register").alias("kind"), F.lit(0.0).alias("record_time"), "speaker", none("double").alias("rms"), none("double").alias("peak"), F.col("centroid").alias("v"), none("binary").alias("pcm"), signals)
    rules = listening.Rules(as_vector, threshold=0.2, update=0.6, rms=5.0, peak=10.0, weigh=False, seconds=60.0, rate=16_000, idle=1e9)
    c = listening.chunks(listening.heard(voices.unionByName(segments), rules, flush=True, results=False), spoken=False)
    return c.select("bucket", "base_id", "speaker", F.round("chunk_start", 3).alias("chunk_start"), F.round("chunk_end", 3).alias("chunk_end"), F.length("pcm").alias("n_bytes"), F.crc32("pcm").alias("crc"))


QUERIES = {
    f.__name__: f
    for f in (
        session_rows, places_at_segments, places_as_of, validated_pairs, averaged_pairs, looks_after_messages, tag_gazes, direct_transforms, levelled_windows, session_movement, one_way_badges, voice_updates_in_order, heard_turns,
    )
}

#: Rows of three bases in order of arrival, and a segment list after the latest row joined it, opened one or passed by.
MESSAGE = "{'b': base_id, 'a': arrival}"
NEAR = "(abs(t - x.s) <= 900 and not list_contains(list_transform(x.ms, lambda m: m.b), base_id))"
STEP = "case when {1} then list_transform({0}, lambda x, i: {2}) else {0} end"

ORACLE_SQL = {
    "session_rows": "select 'session_' || strftime(ts, '%Y-%m-%d') as bucket, event_id from events where ts - interval 6 hour >= date_trunc('day', ts)",
    "places_at_segments": f"""with {PLACES}, s as (select *, (floor(t / 600) * 600)::bigint as segment from p)
        select bucket, segment, arg_min(badge, t) as badge, arg_min(event_id, t) as event_id from s group by bucket, segment""",
    "places_as_of": f"""with {PLACES}, a as (select p.* from p join events using (event_id) where event_type = 'purchase'), r as (select p.* from p join events using (event_id) where event_type in ('view', 'click'))
        select a.event_id as asked, case when a.t - r.t <= 1200 then r.event_id end as event_id, case when a.t - r.t <= 1200 then r.badge end as badge from a asof left join r on a.bucket = r.bucket and a.t >= r.t""",
    "validated_pairs": f"""with {PLACES}, s as (select *, case event_id % 3 when 0 then {{'t': t, 'x': x, 'y': y, 'z': z}} end as m, case event_id % 3 when 1 then {{'t': t, 'x': x, 'y': y, 'z': z}} end as o from p),
        q as (select bucket, badge, event_id, t, last_value(m ignore nulls) over w as m, last_value(o ignore nulls) over w as o from s
        window w as (partition by bucket, badge order by event_id rows between unbounded preceding and current row))
        select bucket as pair, badge as tag, event_id as arrival, round(sqrt((o.z + 1 - m.x) ^ 2 + (o.y + 2 - m.y) ^ 2 + (3 - o.x - m.z) ^ 2), 3) as metres,
        round(degrees(acos(greatest(-1, least(1, cos(radians(90 + 10 * (o.y - m.y))))))), 3) as degrees from q where t - m.t <= 3600 and t - o.t <= 3600""",
    "tag_gazes": f"""with {PLACES}, a as (select *, sin(radians(10 * y)) as s, cos(radians(10 * y)) as c from p),
        g as (select bucket || '/' || floor(t / 3600)::bigint as w, event_id::varchar as tag, x, z, case when s * x + c * z < 0 then s else -s end as nx, case when s * x + c * z < 0 then c else -c end as nz from a),
        q as (select a.w as "window", a.tag, b.tag as target, sqrt((a.x - b.x) ^ 2 + (a.z - b.z) ^ 2) as far, a.nx * (a.x - b.x) + a.nz * (a.z - b.z) as dot from g a join g b on a.w = b.w and a.tag <> b.tag)
        select "window", tag, target, round(dot / far, 5) as score from q where far <= 5 and far > 0 and dot / far < -0.7""",
    "direct_transforms": f"""with {PLACES}, s as (select *, case event_id % 3 when 0 then {{'t': t, 'x': x, 'y': y, 'z': z}} end as m, case event_id % 3 when 1 then {{'t': t, 'x': x, 'y': y, 'z': z}} end as o from p),
        q as (select bucket, badge, event_id, t, last_value(m ignore nulls) over w as m, last_value(o ignore nulls) over w as o from s
        window w as (partition by bucket, badge order by event_id rows between unbounded preceding and current row)),
        d as (select *, radians(10 * (m.y - o.y)) as d from q where t - m.t <= 3600 and t - o.t <= 3600)
        select bucket as pair, badge as tag, event_id as arrival, round(1 + 2 * cos(d), 5) as trace, round(m.x - cos(d) * o.x - sin(d) * o.z, 5) as x, round(m.y - o.y, 5) as y, round(m.z + sin(d) * o.x - cos(d) * o.z, 5) as z from d""",
    "levelled_windows": """with v as (select vec_id, embedding::double[] as v, unnest(range(7)) as no from embeddings), w as (select vec_id, no::int as no, v[no * 8 + 1 : no * 8 + 16] as x from v),
        l as (select vec_id, no, list_transform(x, lambda y: y * 0.1 / sqrt(list_inner_product(x, x) / 16)) as x from w)
        select vec_id, no, round(x[1], 6) as first, round(list_max(list_transform(x, lambda y: abs(y))), 6) as peak, round(sqrt(list_inner_product(x, x) / 16), 6) as rms from l""",
    "looks_after_messages": f"""with {PLACES}, g as (select bucket || '/' || floor(t / 3600)::bigint as w, event_id, badge, x, z, cos(radians(y)) as nx, sin(radians(y)) as nz from p),
        h as (select *, lead(event_id) over (partition by w, badge order by event_id) as until from g),
        q as (select a.w, greatest(a.event_id, b.event_id) as arrival, a.badge as tag, b.badge as target, a.x - b.x as dx, a.z - b.z as dz, a.nx, a.nz
        from h a join h b on a.w = b.w and a.badge <> b.badge and a.event_id < coalesce(b.until, 9e18) and b.event_id < coalesce(a.until, 9e18))
        select w as "window", tag, target, min(arrival) as since from q where dx * dx + dz * dz > 0 and sqrt(dx * dx + dz * dz) <= 20 and (nx * dx + nz * dz) / sqrt(dx * dx + dz * dz) < -0.7 group by all""",
    "session_movement": f"""with {PLACES}, d as (select *, sqrt((x - lag(x) over w) ^ 2 + (y - lag(y) over w) ^ 2 + (z - lag(z) over w) ^ 2) as step, cos(radians(10 * (y - lag(y) over w))) as c from p
        window w as (partition by bucket, badge order by t, event_id)),
        m as (select bucket, sum(coalesce(step, 0)) as stm, sum(coalesce(degrees(acos(greatest(-1, least(1, c)))), 0)) as srm, count(*) as n from d group by bucket)
        select bucket, round(stm, 2) as stm, round(stm / n, 2) as nstm, round(srm, 2) as srm, round(srm / n, 2) as nsrm from m""",
    "one_way_badges": """with a as (select 'session_' || strftime(ts, '%Y-%m-%d') as bucket, event_id, user_id % 25 as src, (user_id + 7) % 25 as one, (user_id + 11) % 25 as two from events),
        t as (select bucket, src, one as dst, event_id from a union all select bucket, src, two, event_id from a union all select bucket, src, one, event_id from a),
        n as (select bucket, count(*) as n from a group by bucket),
        e as (select bucket, src, dst, count(*) as c from t where event_id % 2 = 0 and src < 20 and dst < 20 group by all)
        select bucket, src::varchar as src, dst::varchar as dst, round(c / n, 6) as weight from e a join n using (bucket)
        where not exists (select 1 from e b where b.bucket = a.bucket and b.src = a.dst and b.dst = a.src)""",
    "voice_updates_in_order": f"""with recursive {VOICES}, l as (select speaker, list(x order by i) as c, any_value(n) as n from cells group by all),
        start as (select list(c order by speaker) as c, list(n order by speaker) as n, list(speaker order by speaker) as s from l),
        probes as (select vec_id % 5 as k, u, row_number() over (partition by vec_id % 5 order by vec_id) as r from u),
        walk as (select k, 0::bigint as r, c, n, s from (select distinct k from probes), start
        union all select k, r, {STEP.format("c", "best > 0.3", "case when i = at_most then list_transform(x, lambda y, j: (y * n[i] + u[j]) / (n[i] + 1)) else x end")},
        {STEP.format("n", "best > 0.3", "case when i = at_most then x + 1 else x end")}, s
        from (select w.k, p.r, w.c, w.n, w.s, p.u, list_max(list_transform(w.c, lambda x: list_inner_product(x, p.u))) as best,
        list_position(list_transform(w.c, lambda x: list_inner_product(x, p.u)), list_max(list_transform(w.c, lambda x: list_inner_product(x, p.u)))) as at_most
        from walk w join probes p on p.k = w.k and p.r = w.r + 1)),
        done as (select * from walk where r = (select max(r) from probes where probes.k = walk.k)),
        each as (select k, unnest(s) as speaker, unnest(c) as c, unnest(n) as n from done)
        select 'l' || k as library, speaker, unnest(range(64))::int as i, round(unnest(c), 6) as x, n from each""",
    "reconciled_signals": """with e as (select event_id // 2 as pair, event_id, case event_type when 'error' then 'silent' when 'signup' then 'unknown' else 'spk' || (user_id % 5) end as speaker,
        value as duration from events),
        p as (select a.pair, a.speaker as a, b.speaker as b, a.speaker in ('silent', 'unknown') as na, b.speaker in ('silent', 'unknown') as nb from e a left join e b on a.pair = b.pair and a.event_id < b.event_id
        where a.event_id = (select min(event_id) from e c where c.pair = a.pair)),
        r as (select pair, case when b is null or a = b then [a] when not na and not nb then [a, b] when not na then [a] when not nb then [b] else ['unknown'] end as s from p)
        select pair, array_to_string(s, ',') as speakers, len(list_filter(s, lambda x: x not in ('silent', 'unknown')))::int as n_real from r""",
    "trajectory_pieces": f"""with recursive {PLACES}, g as (select *, case when t - lag(t) over w > 3600 then 1 else 0 end as cut from p window w as (partition by bucket, badge order by t, event_id)),
        h as (select *, sum(cut) over (partition by bucket, badge order by t, event_id rows unbounded preceding) as island from g),
        i as (select bucket, badge, island::int as k, min(t) as a, max(t) as b, count(*) as n from h group by all),
        walk as (select bucket, badge, -1 as k, null::double as wait, 0::bigint as waiting, null::double as start, null::double as finish, null::bigint as points from (select distinct bucket, badge from i)
        union all select w.bucket, w.badge, i.k, case when i.b = i.a and w.wait is null then i.a end, case when i.b = i.a and w.wait is null then i.n else 0 end,
        case when i.b > i.a or w.wait is not null then coalesce(w.wait, i.a) end, case when i.b > i.a or w.wait is not null then i.b end, case when i.b > i.a or w.wait is not null then w.waiting + i.n end
        from walk w join i on i.bucket = w.bucket and i.badge = w.badge and i.k = w.k + 1)
        select bucket, badge, (row_number() over (partition by bucket, badge order by start))::int as piece, round(start, 3) as start, round(finish, 3) as finish, points from walk where points is not null""",
    "aligned_segments": f"""with recursive m as (select 'session_' || strftime(ts, '%Y-%m-%d') as bucket, event_id as arrival, 'b' || (user_id % 3) as base_id, epoch_us(ts) / 1e6 as t,
        row_number() over (partition by strftime(ts, '%Y-%m-%d') order by event_id) as r from events),
        walk as (select bucket, r, floor(t) as latest, [{{'s': floor(t), 'ms': [{MESSAGE}]}}] as held, [{{'s': floor(t), 'ms': [{MESSAGE}]}}][1:0] as done from m where r = 1
        union all select bucket, r, latest, case when full_at > 0 then list_concat(held[1 : full_at - 1], held[full_at + 1 :]) else held end, case when full_at > 0 then list_append(late, held[full_at]) else late end
        from (select *, case when at_x > 0 and len(held[at_x].ms) >= 3 then at_x else 0 end as full_at
        from (select bucket, r, late, case when near_at is null and latest <= t then t else latest end as latest, case when near_at is not null then near_at when latest > t then 0 else len(open) + 1 end as at_x,
        case when near_at is not null then list_transform(open, lambda x, i: case when i = near_at then {{'s': x.s, 'ms': list_append(x.ms, {MESSAGE})}} else x end)
        when latest > t then open else list_append(open, {{'s': t, 'ms': [{MESSAGE}]}}) end as held
        from (select *, list_position(list_transform(open, lambda x: {NEAR} and x.s = list_min(list_transform(list_filter(open, lambda x: {NEAR}), lambda x: x.s))), true) as near_at
        from (select m.bucket, m.r, m.t, m.base_id, m.arrival, w.latest, list_filter(w.held, lambda x: m.t - x.s > 1800) as late, list_filter(w.held, lambda x: m.t - x.s <= 1800) as open
        from walk w join m on m.bucket = w.bucket and m.r = w.r + 1) a) b) c) d),
        each as (select bucket, unnest(done) as x from walk), ms as (select bucket, x.s as segment, unnest(x.ms) as m from each)
        select bucket, segment, m.b as base_id, m.a as arrival from ms""",
    "drift_free_pairs": f"""with recursive {PLACES}, v as (select bucket || '/' || badge as pair, row_number() over (partition by bucket, badge order by event_id) as r, [x % 0.3, y % 0.3, z % 0.3, y % 5] as v from p),
        walk as (select pair, r, v as total, 1::bigint as n, 0::bigint as rejected from v where r = 1
        union all select pair, r, case when out then total else list_transform(total, lambda x, i: x + v[i]) end, case when out then n else n + 1 end, case when out then rejected + 1 else rejected end
        from (select v.pair, v.r, v.v, w.total, w.n, w.rejected,
        sqrt((v.v[1] - w.total[1] / w.n) ^ 2 + (v.v[2] - w.total[2] / w.n) ^ 2 + (v.v[3] - w.total[3] / w.n) ^ 2) > 0.1 or abs(v.v[4] - w.total[4] / w.n) > 3 as out
        from walk w join v on v.pair = w.pair and v.r = w.r + 1) s)
        select w.pair, n, rejected, round(total[1] / n, 6) as x, round(total[2] / n, 6) as y, round(total[3] / n, 6) as z from walk w join (select pair, max(r) as r from v group by pair) using (pair, r)""",
}
