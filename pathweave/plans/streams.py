"""Streaming queries: everything that is there is processed once, so the result can be held against the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave.functions.numeric import r6
from pathweave.operators import segments as seg
from pathweave.plans.fixtures import Data
from pathweave.plans.geometry import TEMPORAL, temporal_candidates
from pathweave.plans.registry import q6, query
from pathweave.session import scratch_dir
from pathweave.streaming import processors as proc
from pathweave.streaming.sources import file_stream, run_to_table


def events(d: Data):
    s = file_stream(d.spark, d.dir, "events.parquet").withColumnRenamed("user_id", "demo_id")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("x01_stream_history", """
select demo_id, event_id, concat_ws(',', coalesce(lag(event_id, 3) over w, first_value(event_id) over w), coalesce(lag(event_id, 2) over w, first_value(event_id) over w),
  coalesce(lag(event_id, 1) over w, first_value(event_id) over w), event_id) as history from fx_steps window w as (partition by demo_id order by t)""")
def stream_history(d: Data):
    return run_to_table(proc.history(events(d).select("demo_id", "ts", "event_id"), 4), "history")


@query("x02_stream_episode", """
with f as (select demo_id, min(t) as ft, max(t) as mt from (select demo_id, t, event_type = 'purchase' as ok from fx_steps) group by 1), s as (select demo_id, min(t) as st from fx_steps where event_type = 'purchase' group by 1)
select demo_id, st is not null as success, (coalesce(st, mt) + 1)::bigint as length from f left join s using (demo_id)""")
def stream_episode(d: Data):
    s = events(d).select("demo_id", "ts", "event_id", (F.col("event_type") == "purchase").alias("success"))
    out = run_to_table(proc.episode(s), "episode")
    return out.groupBy("demo_id").agg(F.bool_or("success").alias("success"), F.max("length").alias("length"))


def state_of():
    # any two-valued signal of an event that needs no frame number
    return F.when(F.col("event_id") * 13 % 29 < 15, 1).otherwise(0)


STATE = """select demo_id, t, case when event_id * 13 % 29 < 15 then 1 else 0 end as st from fx_steps"""


@query("x03_stream_segments", f"""
with h as (select demo_id, t, st from (select *, lag(st) over (partition by demo_id order by t) as p, min(st) over (partition by demo_id order by t rows between current row and 2 following) as mn,
   max(st) over (partition by demo_id order by t rows between current row and 2 following) as mx, count(*) over (partition by demo_id order by t rows between current row and 2 following) as n from ({STATE}))
   where p is null or (st <> p and mn = mx and n = 3))
select demo_id, t, st as state from (select *, lag(st) over (partition by demo_id order by t) as b from h) where b is null or b <> st""")
def stream_segments(d: Data):
    s = events(d).withWatermark("ts", "1 hour").select("demo_id", "ts", "event_id", state_of().alias("state"))
    # one pass over a recording: nothing times out, so changes confirmed by three events are given out
    return run_to_table(proc.segments(s, 3), "segments")


@query("x04_stream_jump_monitor", f"""
with j as (select demo_id, t, event_id, abs(value - lag(value) over (partition by demo_id order by t)) as step from fx_steps)
select demo_id, event_id, {q6('step')} as step, count(*) over (partition by demo_id order by t rows unbounded preceding)::bigint as exceed from j where step > 40""")
def stream_jumps(d: Data):
    out = run_to_table(proc.jumps(events(d).select("demo_id", "ts", "event_id", "value"), 40.0), "jumps")
    return out.select("demo_id", "event_id", r6("step").alias("step"), "exceed")


def window_stats(rows, window):
    g = rows.groupBy(window.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.select(F.unix_seconds("w.start").alias("window_start"), "event_type", "n", r6("s").alias("total"), r6("q").alias("total_sq"), "lo", "hi")


WIN = "count(*)::bigint as n, {s} as total, {q} as total_sq, min(value) as lo, max(value) as hi".format(s=q6("sum(value)"), q=q6("sum(value * value)"))


# A window is written once the watermark, an hour behind the newest event, has passed its end; its state is then dropped.
CLOSED = "<= (select epoch(max(ts)) - 3600 from events)"


@query("x05_stream_stats_tumbling", f"""
select epoch(date_trunc('day', ts))::bigint as window_start, event_type, {WIN} from events group by 1, 2 having epoch(any_value(date_trunc('day', ts))) + 86400 {CLOSED}""")
def stream_stats(d: Data):
    s = events(d).withWatermark("ts", "1 hour")
    return run_to_table(window_stats(s, F.window("ts", "1 day")), "tumbling")


@query("x05_stream_stats_sliding", f"""
select (epoch(ts)::bigint // 21600 - o) * 21600 as window_start, event_type, {WIN}
from (select *, unnest([0, 1, 2, 3]) as o from (select date_trunc('second', ts) as ts, event_type, value from events)) group by 1, 2
having (epoch(ts)::bigint // 21600 - o) * 21600 + 86400 {CLOSED}""")
def stream_stats_sliding(d: Data):
    s = events(d).withWatermark("ts", "1 hour")
    return run_to_table(window_stats(s, F.window("ts", "1 day", "6 hours")), "sliding")


@query("x05_stream_sessions", f"""
with g as (select *, case when ts - lag(ts) over w >= interval 12 hour or lag(ts) over w is null then 1 else 0 end as nw from events window w as (partition by user_id order by ts, event_id)),
 s as (select *, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from g)
select user_id as demo_id, epoch(min(date_trunc('second', ts)))::bigint as session_start, count(*)::bigint as n, {q6('sum(value)')} as total from s group by user_id, sid having epoch(max(ts)) + 43200 {CLOSED}""")
def stream_sessions(d: Data):
    s = events(d).withWatermark("ts", "1 hour")
    g = s.groupBy(F.session_window("ts", "12 hours").alias("w"), "demo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return run_to_table(g.select("demo_id", F.unix_seconds("w.start").alias("session_start"), "n", r6("s").alias("total")), "sessions")


@query("x06_stream_patch_temporal", TEMPORAL)
def stream_patch(d: Data):
    folder = scratch_dir(d.spark, "cands")
    temporal_candidates(d).write.parquet(folder)
    s = d.spark.readStream.schema(d.spark.read.parquet(folder).schema).parquet(folder)
    out = run_to_table(proc.temporal_patch(s, 0.01, 0.2), "patch")
    return out.select("demo_id", "t", "point_id", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@query("f04_resample_table", "select * from (select demo_id, k::int as k, t from (" + """
with u as (select demo_id, t_len - 1 as e, unnest(range(6)) as k from fx_demo),
 w as (select *, case when k / 5.0 <= 0.5 then 0.5 * pow(2.0 * (k / 5.0), 1.2) else 1.0 - 0.5 * pow(2.0 * (1.0 - k / 5.0), 1.6) end as w from u)
select demo_id, k, case when k = 0 then 0 when k = 5 then e else round_even(e * w, 0)::int end as t from w))""")
def resample_table(d: Data):
    """Six frames over the whole demo as a table function: an exploded sequence, no Python."""
    return d.demo().select("demo_id", F.posexplode(seg.resample_indices(F.lit(0), F.col("t_len") - 1, 6)).alias("k", "t"))
