"""Queries over sessions made from the generated tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoke.operators import motion, network, speech
from convoke.sources import adapters
from convoke.sources.measurements import parsed_translations


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def rounded_score(df: DataFrame) -> DataFrame:
    """A score between -1 and -0.1 to five digits, as DuckDB rounds: half a unit is exact there. F.round goes through decimal
    text, which takes longer than all the rest of a pair."""
    return df.withColumn("score", F.ceil(F.col("score") * 1e5 - 0.5).cast("double") / 1e5)


def session_conversation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.speaker_recognition(spark, sf_dir)
    return rounded(speech.conversation_metrics(rows), "apd", "peq", "nttc", "sr")


def dialogue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = speech.conversation_metrics(adapters.turns(spark, sf_dir))
    return rounded(m, "apd", "peq", "nttc", "sr").select("bucket", "n", "apd", "peq", "nttc", "sr")


def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.speaker_recognition(spark, sf_dir)
    report = speech.session_report(rows, speech.conversation_metrics(rows))
    return rounded(report, "apd", "peq", "nttc", "sr").select("bucket", "apd", "peq", "nttc", "sr")


def speaking_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(speech.speaking_time(adapters.speaker_recognition(spark, sf_dir)), "seconds", digits=4)


def similarity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(speech.similarity_grid(adapters.speaker_recognition(spark, sf_dir)), "similarity", "total", "share")


def speaking_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(speech.interactions(adapters.speaker_recognition(spark, sf_dir)), "weight")


def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.first_appearance(adapters.speaker_recognition(spark, sf_dir))


def speaker_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.speaker_chunks(adapters.speaker_recognition(spark, sf_dir), 600.0)


def change_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.change_borders(speaker_chunks(spark, sf_dir))


def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.merged_chunks(speaker_chunks(spark, sf_dir))


def physical_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.physical_interactions(adapters.badge_relations(spark, sf_dir)), "weight")


def physical_interactions_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.physical_interactions(adapters.badge_relations(spark, sf_dir), strict=False), "weight")


def node_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = network.strengths(speech.interactions(adapters.speaker_recognition(spark, sf_dir)))
    return rounded(s.withColumn("size", network.node_size(F.col("strength"))), "strength", "size", digits=5)


def reciprocal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = network.reciprocal(speech.interactions(adapters.speaker_recognition(spark, sf_dir)))
    return rounded(edges.withColumn("width", network.line_width(F.col("weight"))), "weight", "width", digits=5)


def one_way_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.one_way(speech.interactions(adapters.speaker_recognition(spark, sf_dir))), "weight")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_translations(adapters.badge_translations(spark, sf_dir))


def translate_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.translate_movement(_positions(spark, sf_dir)), "movement", digits=4)


def translate_movement_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.badge_translations(spark, sf_dir)
    m = motion.per_session(motion.translate_movement(parsed_translations(rows)), rows, "stm", "nstm")
    return rounded(m, "stm", "nstm", digits=4)


def rotate_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.rotate_movement(adapters.badge_rotations(spark, sf_dir), clip=True), "movement", digits=2)


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.heat_map(_positions(spark, sf_dir))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motion.markers(_positions(spark, sf_dir))
    return rounded(m.select("bucket", "badge", *(F.col(f"{e}.{a}").alias(f"{e}_{a}") for e in ("start", "finish") for a in "xyz")), *(f"{e}_{a}" for e in ("start", "finish") for a in "xyz"))


def trajectory_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(motion.trajectory_pieces(_positions(spark, sf_dir), 3600.0), "start", "finish", digits=3)


QUERIES = {
    f.__name__: f
    for f in (
        session_conversation_metrics, dialogue_metrics, session_report, speaking_time, similarity_grid, speaking_interactions, first_appearance, speaker_chunks, change_borders, merged_chunks,
        physical_interactions, physical_interactions_loose, node_strengths, reciprocal_edges, one_way_edges, translate_movement, translate_movement_sessions, rotate_movement, heat_map, markers, trajectory_pieces,
    )
}

#: A row for each speaker entry, and the segments with their lists.
ENTRIES = """
e as (select 'session_' || strftime(ts, '%Y-%m-%d') as bucket, (floor(epoch_us(ts) / 600000000.0) * 600)::double as seg,
    case event_type when 'error' then 'silent' when 'signup' then 'unknown' else 'spk' || (user_id % 5) end as speaker,
    value as duration, value / 500 as similarity, event_id, epoch_us(ts) as us from events),
s as (select bucket, seg, list(speaker order by us, event_id) as speakers, list(duration order by us, event_id) as durations
    from e group by all)"""
METRICS = """
k as (select *, lead(speakers) over (partition by bucket order by seg) as next from s where not list_contains(speakers, 'unknown')),
x as (select bucket, next, unnest(speakers) as speaker, unnest(durations) as duration from k),
n as (select bucket, count(*) as n from k group by all),
c as (select bucket, speaker, count(*) as c from x where speaker not in ('silent', 'unknown') group by all),
g as (select a.bucket, 1 - sum(abs(a.c - b.c)) / (2.0 * count(distinct a.speaker) ^ 2 * (sum(a.c) / count(*))) as peq
    from c a join c b using (bucket) group by a.bucket),
m as (select bucket, count(*) filter (next is not null and not list_contains(next, 'silent') and not list_contains(next, speaker)) as turns,
    sum(duration) filter (speaker = 'silent') as silence, sum(duration) as seconds,
    count(*) filter (speaker = 'silent' and (next is null or not list_contains(next, 'silent'))) as flushes from x group by all),
metrics as (select n.bucket, split_part(n.bucket, '_', 2) as session, n, round(case when n <= 1 or flushes = 0 then 0 else silence / flushes end, 6) as apd,
    round(case when n > 1 then peq end, 6) as peq, round(case when n <= 1 then 0 else turns / n end, 6) as nttc,
    round(case when n <= 1 or silence is null then 0 else silence / seconds end, 6) as sr
    from n left join m using (bucket) left join g using (bucket))"""
EDGES = """
r as (select bucket, list_filter(speakers, lambda x: x not in ('silent', 'unknown')) as cur,
    lead(list_filter(speakers, lambda x: x not in ('silent', 'unknown'))) over (partition by bucket order by seg) as next, count(*) over (partition by bucket) as n from s),
p as (select bucket, n, cur, unnest(next) as src from r),
q as (select bucket, n, src, unnest(cur) as dst from p),
edges as (select bucket, src, dst, count(*) / any_value(n) as weight from q where src <> dst group by all)"""
CHUNKS = """
u as (select *, row_number() over (partition by bucket order by seg) as rn, lead(seg) over (partition by bucket order by seg) as after from s),
v as (select bucket, rn, seg, unnest(speakers) as speaker, unnest(range(len(speakers))) as place from u),
w as (select bucket, rn, seg, speaker, min(place) as place from v group by all),
i as (select *, rn - row_number() over (partition by bucket, speaker order by rn) as island from w),
j as (select bucket, speaker, island, min(seg) as chunk_start, max(rn) as closing, max(seg) as last, min(rn) as opening, arg_min(place, rn) as place
    from i group by all),
l as (select j.*, u.after from j join u on j.bucket = u.bucket and j.closing = u.rn),
chunks as (select bucket, speaker, chunk_start, coalesce(after, last + 600) as chunk_end,
    row_number() over (partition by bucket order by closing, opening, place) as no from l)"""
PLACES = """
p as (select 'session_' || strftime(ts, '%Y-%m-%d') as bucket, (user_id % 25)::varchar as badge, epoch_us(ts) / 1e6 as t,
    value / 10 as x, (props ->> '$.k')::double / 10 as y, (value + (props ->> '$.k')::double) / 20 as z, event_id from events)"""
MOVES = """
d as (select *, sqrt((x - lag(x) over w) ^ 2 + (y - lag(y) over w) ^ 2 + (z - lag(z) over w) ^ 2) as step from p
    window w as (partition by bucket, badge order by t, event_id)),
moves as (select bucket, badge, sum(coalesce(step, 0)) as movement from d group by all)"""
GRAPH = """
a as (select 'session_' || strftime(ts, '%Y-%m-%d') as bucket, event_id, (user_id % 25)::varchar as src, ((user_id + 7) % 25)::varchar as one,
    ((user_id + 11) % 25)::varchar as two from events),
t as (select bucket, src, one as dst, event_id from a union all select bucket, src, two, event_id from a
    union all select bucket, src, one, event_id from a where event_id % 2 = 0)"""
IN_RANGE = "src::int < 20 and dst::int < 20 and src <> dst"

ORACLE_SQL = {
    "session_conversation_metrics": f"with {ENTRIES}, {METRICS} select * from metrics",
    "dialogue_metrics": f"""with s as (select 'session_' || conv_id as bucket, turn as seg, [case role when 'system' then 'silent' else role end] as speakers,
        [length(text)::double] as durations from conversations), {METRICS} select bucket, n, apd, peq, nttc, sr from metrics""",
    "session_report": f"""with {ENTRIES}, {METRICS}, every as (select distinct bucket from s)
        select bucket, apd, peq, nttc, sr from every left join metrics using (bucket)""",
    "speaking_time": f"with {ENTRIES} select bucket, speaker, round(sum(duration), 4) as seconds, count(*) as segments from e group by all",
    "similarity_grid": f"""with {ENTRIES}, h as (select bucket, seg, speaker, sum(similarity) as sim from e group by all),
        names as (select distinct bucket, speaker from e), total as (select bucket, seg, sum(sim) as total from h group by all)
        select bucket, seg as segment_start_time, speaker, round(coalesce(sim, 0), 6) as similarity, round(total, 6) as total,
        round(case when total = 0 then 0 else coalesce(sim, 0) / total end, 6) as share
        from total join names using (bucket) left join h using (bucket, seg, speaker)""",
    "speaking_interactions": f"with {ENTRIES}, {EDGES} select bucket, src, dst, round(weight, 6) as weight from edges",
    "first_appearance": f"""with {ENTRIES}, f as (select bucket, speaker, min(us::hugeint * 100000000 + event_id) as first from e group by all)
        select bucket, speaker, row_number() over (partition by bucket order by first)::int as label from f""",
    "speaker_chunks": f"with {ENTRIES}, {CHUNKS} select bucket, speaker, chunk_start, chunk_end, no::int as no from chunks",
    "change_borders": f"""with {ENTRIES}, {CHUNKS}, b as (select *, lag(speaker) over w as before, first(chunk_start) over w as origin from chunks
        window w as (partition by bucket order by no)) select bucket, no::int as no, chunk_start - origin as "offset", before, speaker from b where before <> speaker""",
    "merged_chunks": f"""with {ENTRIES}, {CHUNKS}, b as (select *, case when lag(speaker) over (partition by bucket order by no) = speaker then 0 else 1 end as new
        from chunks where chunk_end <> chunk_start), r as (select *, sum(new) over (partition by bucket order by no) as run from b)
        select bucket, run::bigint as run, any_value(speaker) as speaker, arg_min(chunk_start, no) as chunk_start, arg_max(chunk_end, no) as chunk_end from r group by bucket, run""",
    "physical_interactions": f"""with {GRAPH}, n as (select bucket, count(*) as n from a group by all)
        select bucket, src, dst, round(count(*) / any_value(n), 6) as weight from t join n using (bucket) where event_id % 2 = 0 and {IN_RANGE} group by bucket, src, dst""",
    "physical_interactions_loose": f"""with {GRAPH}, n as (select bucket, count(*) as n from a group by all)
        select bucket, src, dst, round(count(*) / any_value(n), 6) as weight from t join n using (bucket) where {IN_RANGE} group by bucket, src, dst""",
    "node_strengths": f"""with {ENTRIES}, {EDGES}, b as (select bucket, src as node, weight from edges union all select bucket, dst, 0 from edges),
        z as (select bucket, node, sum(weight) as strength from b group by all)
        select bucket, node, round(strength, 5) as strength, round(case when strength = 0 then 500 else 500 + strength / 0.5 * 1500 end, 5) as size from z""",
    "reciprocal_edges": f"""with {ENTRIES}, {EDGES} select a.bucket, a.src, a.dst, round(a.weight, 5) as weight,
        round(1 + least(greatest(a.weight, 0), 0.5) / 0.5 * 19, 5) as width from edges a join edges b on a.bucket = b.bucket and a.src = b.dst and a.dst = b.src""",
    "one_way_edges": f"""with {ENTRIES}, {EDGES} select bucket, src, dst, round(weight, 6) as weight from edges a
        where not exists (select 1 from edges b where a.bucket = b.bucket and a.src = b.dst and a.dst = b.src)""",
    "translate_movement": f"with {PLACES}, {MOVES} select bucket, badge, round(movement, 4) as movement from moves",
    "translate_movement_sessions": f"""with {PLACES}, {MOVES}, n as (select bucket, count(*) as n from p group by all)
        select bucket, round(sum(movement), 4) as stm, round(sum(movement) / any_value(n), 4) as nstm from moves join n using (bucket) group by bucket""",
    "rotate_movement": f"""with {PLACES}, d as (select *, cos(radians(10 * (y - lag(y) over w))) as c from p window w as (partition by bucket, badge order by t, event_id))
        select bucket, badge, round(sum(coalesce(degrees(acos(greatest(-1, least(1, c)))), 0)), 2) as movement from d group by all""",
    "heat_map": f"""with {PLACES}, o as (select *, min(z) over w as z0, max(z) over w as z1, min(x) over w as x0, max(x) over w as x1 from p where badge::int < 20
        window w as (partition by bucket))
        select bucket, least(floor(coalesce((z - z0) / nullif(z1 - z0, 0), 0) * 50), 49)::bigint as zi, least(floor(coalesce((x - x0) / nullif(x1 - x0, 0), 0) * 50), 49)::bigint as xi,
        count(*) as n from o group by all""",
    "markers": f"""with {PLACES}, o as (select *, row_number() over (partition by bucket, badge order by t, event_id) as a,
        row_number() over (partition by bucket, badge order by t desc, event_id desc) as b from p)
        select f.bucket, f.badge, round(f.x, 6) as start_x, round(f.y, 6) as start_y, round(f.z, 6) as start_z, round(l.x, 6) as finish_x, round(l.y, 6) as finish_y,
        round(l.z, 6) as finish_z from o f join o l using (bucket, badge) where f.a = 1 and l.b = 1""",
}
