"""Temporal operators over steps and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave.functions.numeric import hash_u32, r6, text
from pathweave.operators import sampling as smp
from pathweave.operators.motion import backward_flow, second_difference
from pathweave.operators.segments import carry_forward, join_interval
from pathweave.operators.sequence import BLK, HALO, over_neighbours, prefix, with_halo
from pathweave.plans.fixtures import Data
from pathweave.plans.registry import h32, q6, query


@query("w02_backward_flow", """
select demo_id, t, point_id, coalesce(xu - lag(xu) over w, 0) as dxu, coalesce(yu - lag(yu) over w, 0) as dyu,
       coalesce(zu - lag(zu) over w, 0) as dzu from fx_tracks window w as (partition by demo_id, point_id order by t)""")
def backward(d: Data):
    return backward_flow(d.tracks()).select("demo_id", "t", "point_id", "dxu", "dyu", "dzu")


@query("w06_second_difference", """
select * from (select demo_id, t, point_id, lead(xu) over w - 2 * xu + lag(xu) over w as ddxu, lead(yu) over w - 2 * yu + lag(yu) over w as ddyu,
       lead(zu) over w - 2 * zu + lag(zu) over w as ddzu from fx_tracks window w as (partition by demo_id, point_id order by t))
where ddxu is not null""")
def second(d: Data):
    return second_difference(d.tracks()).select("demo_id", "t", "point_id", "ddxu", "ddyu", "ddzu")


@query("w07_next_action", """
select * from (select s.demo_id, s.t, value as state, case when s.t = t_len - 1 then value when lead(s.t) over w = s.t + 1 then lead(value) over w end as action
from fx_steps s join fx_demo using (demo_id) where event_type <> 'error' window w as (partition by s.demo_id order by s.t)) where action is not null""")
def next_action(d: Data):
    there = d.steps().filter("event_type <> 'error'").select("demo_id", "t", "value")
    nxt = over_neighbours(there, ["demo_id"], "t", lambda w: {
        "n": F.when(F.lead("t").over(w) == F.col("t") + 1, F.lead("value").over(w))}, before=0, after=1)
    last = F.when(F.col("t") == F.col("t_len") - 1, F.col("value"))
    return nxt.join(d.demo().select("demo_id", "t_len"), "demo_id").select(
        "demo_id", "t", F.col("value").alias("state"), F.coalesce(last, "n").alias("action")).filter("action is not null")


@query("w08_action_chunk", """
select demo_id, t as s, array_to_string(chunk, ',') as chunk from (
 select s.demo_id, s.t, t_len, list(grip) over (partition by s.demo_id order by s.t rows between current row and 7 following) as chunk
 from fx_steps s join fx_demo using (demo_id)) where t <= t_len - 8 - 1""")
def action_chunk(d: Data, k: int = 8):
    c = over_neighbours(d.steps().select("demo_id", "t", "grip"), ["demo_id"], "t", lambda w: {
        "chunk": F.collect_list("grip").over(w.rowsBetween(0, k - 1))}, before=0, after=k - 1)
    c = c.join(d.demo().select("demo_id", "t_len"), "demo_id").filter(F.col("t") <= F.col("t_len") - k - 1)
    return c.select("demo_id", F.col("t").alias("s"), F.array_join(F.col("chunk").cast("array<string>"), ",").alias("chunk"))


@query("w09_pad_or_trim", """
select d.demo_id, w.t::int as t, s.grip as edge, case when w.t < t_len then s.grip else 0 end as zeros, case when w.t < t_len then s.grip else 1 end as ones
from fx_demo d cross join (select unnest(range(64)) as t) w join fx_steps s on s.demo_id = d.demo_id and s.t = least(w.t, t_len - 1)""")
def pad_or_trim(d: Data):
    steps = d.steps().select("demo_id", "t", F.col("grip").alias("edge"), F.col("grip").alias("g0"), F.col("grip").alias("g1"))
    edge = smp.pad_or_trim(steps, d.demo().select("demo_id", "t_len"), 64, ["demo_id"], ["edge"])
    zeros = smp.pad_or_trim(steps, d.demo().select("demo_id", "t_len"), 64, ["demo_id"], ["g0"], "zeros")
    ones = smp.pad_or_trim(steps, d.demo().select("demo_id", "t_len"), 64, ["demo_id"], ["g1"], "ones")
    return edge.join(zeros, ["demo_id", "t"]).join(ones, ["demo_id", "t"]).select(
        "demo_id", "t", "edge", F.col("g0").alias("zeros"), F.col("g1").alias("ones"))


@query("w10_history", """
with h as (select demo_id, t as s, greatest(t - 9, 0) as st from fx_steps),
 l as (select demo_id, s, st, range(st, s + 1, 3) as r from h)
select demo_id, s, j::int as j, (case when j < 4 - len(r) then st else r[j - (4 - len(r)) + 1] end)::int as t
from l cross join (select unnest(range(4)) as j)""")
def history(d: Data):
    return d.steps().select("demo_id", F.col("t").alias("s"), F.posexplode(
        smp.history_indices(F.col("t"), 4, 3)).alias("j", "t"))


@query("w11_cummax", """
select demo_id, t, max((t * 37 + event_id) % 50 + cast(t / 4 as int)) over (partition by demo_id order by t rows unbounded preceding) as idx from (select demo_id, t - t % 4 as tt, t, event_id from fx_steps)""")
def cummax(d: Data):
    # block size 16 on purpose: the carry between blocks is part of what is compared
    s = d.steps().withColumn("raw", (F.col("t") * 37 + F.col("event_id")) % 50 + F.rint(F.col("t") / 4).cast("int"))
    return prefix(s.select("demo_id", "t", "raw"), ["demo_id"], "t", {"idx": ("max", "raw")}, size=16).select("demo_id", "t", "idx")


LISTING = """select demo_id, kind, t as idx from fx_steps join fx_demo using (demo_id) cross join (select unnest(['main', 'wrist']) as kind)
where case when kind = 'main' then not ((demo_id % 3 = 0 and t >= t_len - demo_id % 5) or (demo_id % 5 = 4 and t = 7))
      else not (demo_id % 4 = 1 and t >= t_len - 2) end"""


@query("w15_tail_pad_pairs", f"""
with l as ({LISTING}), p as (select demo_id, idx from l group by 1, 2 having count(distinct kind) = 2),
 lp as (select demo_id, max(idx) as last_paired from p group by 1),
 miss as (select demo_id, kind, min(rn) as first_missing from (
    select demo_id, kind, idx, row_number() over (partition by demo_id, kind order by idx) - 1 as rn from l) where idx <> rn group by 1, 2)
select demo_id, last_paired::int as last_paired, coalesce(min(first_missing) <= last_paired, false) = false as ok,
  case when coalesce(min(first_missing) <= last_paired, false) then 0 else t_len - 1 - last_paired end::int as padded
from lp join fx_demo using (demo_id) left join miss using (demo_id) group by demo_id, last_paired, t_len""")
def tail_pad_pairs(d: Data):
    kinds = F.explode(F.array(F.lit("main"), F.lit("wrist"))).alias("kind")
    base = d.steps().select("demo_id", "t").join(d.demo().select("demo_id", "t_len"), "demo_id").select("demo_id", "t", "t_len", kinds)
    gone = F.when(F.col("kind") == "main", ((F.col("demo_id") % 3 == 0) & (F.col("t") >= F.col("t_len") - F.col("demo_id") % 5))
                  | ((F.col("demo_id") % 5 == 4) & (F.col("t") == 7))).otherwise(
        (F.col("demo_id") % 4 == 1) & (F.col("t") >= F.col("t_len") - 2))
    listing = base.filter(~gone).withColumn("one", F.lit(1))
    ranked = prefix(listing, ["demo_id", "kind"], "t", {"n": ("sum", "one")})
    per_kind = ranked.groupBy("demo_id").agg(F.min(F.when(F.col("t") != F.col("n") - 1, F.col("n") - 1)).alias("first_missing"),
                                             F.max("t_len").alias("t_len"))
    paired = listing.groupBy("demo_id", "t").agg(F.count_distinct("kind").alias("k")).filter("k = 2")
    last = paired.groupBy("demo_id").agg(F.max("t").alias("last_paired"))
    bad = F.coalesce(F.col("first_missing") <= F.col("last_paired"), F.lit(False))
    return last.join(per_kind, "demo_id").select(
        "demo_id", "last_paired", (~bad).alias("ok"),
        F.when(bad, 0).otherwise(F.col("t_len") - 1 - F.col("last_paired")).cast("int").alias("padded"))


@query("w17_subsample", f"""
select demo_id, event_id from (select *, row_number() over (partition by demo_id order by {h32('demo_id', 'event_id', "'corr'", '0')}, event_id) as r from fx_steps) where r <= 20""")
def subsample(d: Data):
    ev = d.table("events").select(F.col("user_id").alias("demo_id"), "event_id")
    return smp.subsample(ev, ["demo_id"], ["event_id"], 20, "corr")


@query("w18_oversample", f"""
select demo_id, r::int as r, (case when r < t_len then r else {h32('demo_id', "'over'", 'r', '0')} % t_len end)::int as t
from (select *, unnest(range(greatest(t_len, 80))) as r from fx_demo)""")
def oversample(d: Data):
    return smp.oversample(d.demo(), ["demo_id"], "t_len", 80).select("demo_id", "r", "t")


@query("w19_linspace_pick", """
select p.demo_id, i::int as i, s1.event_id as trunc_event, s2.event_id as round_event
from (select *, unnest(range(10)) as i from fx_demo) p
join fx_steps s1 on s1.demo_id = p.demo_id and s1.t = floor(i * (t_len - 1) / 9.0)
join fx_steps s2 on s2.demo_id = p.demo_id and s2.t = round_even(i * (t_len - 1) / 9.0, 0)""")
def linspace_pick(d: Data):
    i = d.demo().select("demo_id", "t_len", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    out = i
    for kind in ("trunc", "round"):
        ev = d.steps().select("demo_id", F.col("t").alias(f"{kind}_t"), F.col("event_id").alias(f"{kind}_event"))
        out = out.withColumn(f"{kind}_t", smp.linspace_index(F.col("i"), F.col("t_len"), 10, kind)).join(ev, ["demo_id", f"{kind}_t"])
    return out.select("demo_id", "i", "trunc_event", "round_event")


@query("w20_stratified_pick", f"""
select demo_id, (row_number() over (partition by demo_id order by x) - 1)::int as j, x::int as t from (
 select demo_id, floor(least(greatest(i * step + case when i in (0, 9) then 0.0 else (({h32('demo_id', "'strat'", 'i', '0')} / 4294967296.0) * 2 - 1) * step * 0.4 end, 0.0), (t_len - 1)::double)) as x
 from (select *, unnest(range(10)) as i, (t_len - 1) / 9 as step from fx_demo))""")
def stratified(d: Data):
    return d.demo().select("demo_id", F.posexplode(smp.stratified_indices(F.col("t_len"), 10, ["demo_id"])).alias("j", "t"))


@query("w21_random_pick", f"""
select demo_id, (row_number() over (partition by demo_id order by x) - 1)::int as j, x::int as t from (
 select demo_id, case when i = 0 then 0 else {h32('demo_id', "'rand'", 'i', '0')} % t_len end as x from (select *, unnest(range(12)) as i from fx_demo))""")
def random_pick(d: Data):
    return d.demo().select("demo_id", F.posexplode(smp.random_indices(F.col("t_len"), 12, ["demo_id"])).alias("j", "t"))


@query("w22_chunk_overlap", """
select demo_id, (t // 16 + o)::int as chunk, t, o = 1 as context from fx_steps join fx_demo using (demo_id) cross join (select unnest([0, 1]) as o)
where o = 0 or (t % 16 >= 14 and (t // 16 + 1) * 16 < t_len)""")
def chunk_overlap(d: Data):
    c = with_halo(d.steps().select("demo_id", "t"), "t", before=2, after=0, size=16)
    c = c.join(d.demo().select("demo_id", "t_len"), "demo_id").filter(F.col(BLK) * 16 < F.col("t_len"))
    return c.select("demo_id", F.col(BLK).cast("int").alias("chunk"), "t", F.col(HALO).alias("context"))


@query("w23_carry_forward", """
select demo_id, t, coalesce(last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by demo_id order by t rows unbounded preceding), -1) as scene
from fx_steps""")
def carry(d: Data):
    s = d.steps().select("demo_id", "t", F.when(F.col("event_type") == "view", F.col("event_id")).alias("here"))
    return carry_forward(s, "here", "scene", size=16).select("demo_id", "t", F.coalesce("scene", F.lit(-1)).alias("scene"))


@query("w24_dones", "select demo_id, t, (t = t_len - 1)::int as done from fx_steps join fx_demo using (demo_id)")
def dones(d: Data):
    return d.steps().select("demo_id", "t").join(d.demo().select("demo_id", "t_len"), "demo_id").select(
        "demo_id", "t", (F.col("t") == F.col("t_len") - 1).cast("int").alias("done"))


@query("w25_drift", f"""
select demo_id, t, sum({h32('demo_id', 't', "'drift'", '0')} % 21 - 10) over (partition by demo_id order by t rows unbounded preceding)::bigint as drift from fx_steps""")
def drift(d: Data):
    s = d.steps().select("demo_id", "t", (hash_u32("demo_id", "t", text("drift"), 0) % 21 - 10).alias("noise"))
    return prefix(s, ["demo_id"], "t", {"drift": ("sum", "noise")}, size=16).select("demo_id", "t", "drift")


@query("w26_train_val_split", f"""
with r as (select event_type, event_id, count(*) over (partition by event_type) as n,
   row_number() over (partition by event_type order by {h32('event_type', 'event_id', "'split'", '0')}, event_id) as rk from events)
select event_type, event_id, case when rk <= floor(n * 0.02) then 'val' else 'train' end as split2,
  case when rk <= floor(n * 0.05) then 'val' else 'train' end as split5,
  case when n < 8 then 'both' when rk <= least(greatest(round_even(n * 0.2, 0), 1), n - 3) then 'val' else 'train' end as split20 from r""")
def train_val(d: Data):
    # few event types: every key is hot, so ranks are built from hash ranges
    ev = d.table("events").select("event_type", "event_id")
    ranked = smp.hash_ranked(ev, ["event_type"], ["event_id"], "split")
    n = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    out = ranked.join(n, "event_type")

    def split(f: float, rule: str):
        s = F.when(F.col("rank") < smp.split_sizes(F.col("n"), f, rule), "val").otherwise("train")
        return F.when(F.col("n") < 8, "both").otherwise(s) if rule == "calibration" else s

    return out.select("event_type", "event_id", split(0.02, "truncate").alias("split2"),
                      split(0.05, "truncate").alias("split5"), split(0.2, "calibration").alias("split20"))


@query("w27_refresh_plan", """
select demo_id, t, first_value(event_id) over (partition by demo_id, t // 8 order by t) as plan from fx_steps""")
def refresh_plan(d: Data, c: int = 8):
    s = d.steps().select("demo_id", "t", "event_id", F.floor(F.col("t") / c).alias("b"))
    from pyspark.sql import Window as W
    w = W.partitionBy("demo_id", "b").orderBy("t")  # c rows per group
    return s.select("demo_id", "t", F.first("event_id").over(w).alias("plan"))


@query("s07_slice_flat_episodes", """
with ep as (select demo_id, t_len, coalesce(sum(t_len) over (order by demo_id rows between unbounded preceding and 1 preceding), 0) as off from fx_demo)
select e.event_id as pos, ep.demo_id as episode, (e.event_id - off)::int as t from events e join ep on e.event_id >= off and e.event_id < off + t_len
where (e.event_id - off) % 2 = 0""")
def slice_flat(d: Data, stride: int = 2):
    ep = d.demo().select(F.lit(0).alias("g"), F.col("demo_id").alias("episode"), F.col("t_len").cast("bigint").alias("t_len"))
    ep = prefix(ep, ["g"], "episode", {"off": ("sum", "t_len")}, exclusive=True)
    ep = ep.withColumn("lo", F.coalesce("off", F.lit(0))).withColumn("hi", F.col("lo") + F.col("t_len"))
    flat = d.table("events").select(F.lit(0).alias("g"), F.col("event_id").alias("pos"))
    hit = join_interval(flat, ep.select("g", "episode", "lo", "hi"), ["g"], "pos", "lo", "hi")
    return hit.withColumn("t", (F.col("pos") - F.col("lo")).cast("int")).filter(F.col("t") % stride == 0).select("pos", "episode", "t")


@query("j22_common_length", """
with l as (select demo_id, min(t_len - (demo_id * 7 + kid * 3) % 5) as n from fx_demo join fx_catalog using (demo_id) group by 1)
select demo_id, t, n::bigint as n from fx_steps join l using (demo_id) where t < n""")
def common_length(d: Data):
    l = d.demo().join(d.catalog(), "demo_id").groupBy("demo_id").agg(
        F.min(F.col("t_len") - (F.col("demo_id") * 7 + F.col("kid") * 3) % 5).alias("n"))
    return d.steps().select("demo_id", "t").join(l, "demo_id").filter("t < n")


@query("j23_interp_linear", f"""
with src as (select demo_id, t // 3 as ts, point_id, xu, yu, zu from fx_tracks where t % 3 = 0),
 g as (select demo_id, t, point_id, t // 3 as l, least(t // 3 + 1, (t_len - 1) // 3) as r from fx_tracks join fx_demo using (demo_id))
select g.demo_id, g.t, g.point_id, {q6('a.xu + (b.xu - a.xu) * (case when r = l then 0 else (g.t - 3 * l) / 3.0 end)')} as x,
 {q6('a.yu + (b.yu - a.yu) * (case when r = l then 0 else (g.t - 3 * l) / 3.0 end)')} as y
from g join src a on a.demo_id = g.demo_id and a.point_id = g.point_id and a.ts = g.l join src b on b.demo_id = g.demo_id and b.point_id = g.point_id and b.ts = g.r""")
def interp_linear(d: Data, stride: int = 3):
    # the length meets the frames and a block's frames come together before their points are written out
    tr = d.tracks(d.demo().select("demo_id", "t_len"), halo=(0, stride))
    src = tr.filter(F.col("t") % stride == 0).withColumn("ts", F.floor(F.col("t") / stride).cast("int")).drop("t", "vis")
    up = smp.upsample_linear(src, None, stride, ["demo_id", "point_id"], ["xu", "yu"])
    return up.select("demo_id", "t", "point_id", r6("xu").alias("x"), r6("yu").alias("y"))


@query("j24_repeat_nearest", """
select f.demo_id, f.t, s.event_id as src from fx_steps f join fx_demo using (demo_id)
join fx_steps s on s.demo_id = f.demo_id and s.t = least(f.t // 3, (t_len - 1) // 3) * 3""")
def repeat_nearest(d: Data, stride: int = 3):
    src = d.steps().filter(F.col("t") % stride == 0).select("demo_id", F.floor(F.col("t") / stride).alias("ts"), F.col("event_id").alias("src"))
    f = d.steps().select("demo_id", "t").join(d.demo().select("demo_id", "t_len"), "demo_id")
    f = f.withColumn("ts", F.least(F.floor(F.col("t") / stride), F.floor((F.col("t_len") - 1) / stride)))
    return f.join(src, ["demo_id", "ts"]).select("demo_id", "t", "src")


@query("p09_frame_stride", """
select demo_id, t from fx_steps join fx_demo using (demo_id) where t % 7 = 0 or t = t_len - 1""")
def frame_stride(d: Data):
    s = d.steps().select("demo_id", "t").join(d.demo().select("demo_id", "t_len"), "demo_id")
    return s.filter((F.col("t") % 7 == 0) | (F.col("t") == F.col("t_len") - 1)).select("demo_id", "t")
