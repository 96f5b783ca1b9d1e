"""Segmentation, keyframes and training windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave.functions.numeric import r6
from pathweave.operators import segments as seg
from pathweave.plans.fixtures import Data
from pathweave.plans.registry import q6, query
from pathweave.session import materialize, scratch_dir
from pathweave.sources.tables import write_nested

K = 8


def signal(d: Data):
    return seg.binarize(d.grips(), "grip")


def stage_segments(d: Data, min_len: int = 10):
    return seg.segments(signal(d), "state", 3, min_len, d.demo(), "stage")


def policy_segments(d: Data):
    s = seg.binarize(d.grips(), "grip", rule="zero")
    return seg.segments(s, "state", 3, 0, d.demo(), "inference")


@query("w03_binarize", """
select demo_id, t, case when grip > (mn + mx) * 0.5 then 1 else 0 end as close_plus,
  case when grip < (mn + mx) * 0.5 then 1 else 0 end as close_minus,
  case when (grip - 0.5) * 2.0 > 0 then 1 else 0 end as rescaled, case when vv > (vmn + vmx) * 0.5 then 1 else 0 end as value_state
from (select *, min(grip) over w as mn, max(grip) over w as mx, min(vv) over w as vmn, max(vv) over w as vmx from (
   select *, case when event_id % 17 = 0 then 0.0 else value end as vv from fx_steps) window w as (partition by demo_id))""")
def binarize_query(d: Data):
    s = d.steps().withColumn("vv", F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    s = seg.binarize(s, "grip", out="close_plus")
    s = seg.binarize(s, "grip", plus_is_close=False, out="close_minus")
    s = seg.binarize(s, "grip", rule="zero", rescale=True, out="rescaled")
    s = seg.binarize(s, "vv", out="value_state")
    return s.select("demo_id", "t", "close_plus", "close_minus", "rescaled", "value_state")


@query("w04_debounce", "select demo_id, s0 as t from fx_segments")
def debounce(d: Data):
    return seg.debounced_changes(signal(d), "state", 3).select("demo_id", "t")


@query("w04_debounce_off", """
select demo_id, t from (select demo_id, t, grip, lag(grip) over (partition by demo_id order by t) as p from fx_steps)
where p is null or p <> grip""")
def debounce_off(d: Data):
    return seg.debounced_changes(signal(d), "state", 1).select("demo_id", "t")


SEG_VARIANTS = {
    "stage": """select demo_id, s0, s1 from fx_segments where s1 - s0 >= 10 union all
select demo_id, 0, t_len from fx_demo where t_len >= 10 and demo_id not in (select demo_id from fx_segments where s1 - s0 >= 10)""",
    "viewer": "select demo_id, s0, s1 from fx_segments where s1 - s0 >= 10 and (not is_last or n_bound = 1)",
    "training": "select demo_id, s0, s1 from fx_segments where n_bound = 1 or (s1 - s0 >= 10 and not is_last)",
    "inference": "select demo_id, s0, s1 from fx_segments",
}


@query("w05_segments", " union all ".join(
    f"select '{k}' as variant, demo_id, s0::int as s0, s1::int as s1 from ({v})" for k, v in SEG_VARIANTS.items()))
def segments_query(d: Data):
    n = d.demo()
    b = materialize(seg.boundaries(signal(d), "state", 3, n), "boundaries")  # a few rows per demo, used by four rules
    parts = [seg.choose_segments(b, n, 10, v, keep_last=v in ("stage", "inference")).select(
        F.lit(v).alias("variant"), "demo_id", "s0", "s1") for v in SEG_VARIANTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STAGE_CTE = f"sg as ({SEG_VARIANTS['stage']})"


@query("w12_anchors", f"""
with {STAGE_CTE} select demo_id, s0::int as s0, s1::int as s1, unnest(range(s0, s1 - 1, 2))::int as s from sg where s1 - s0 >= 10""")
def anchors_query(d: Data):
    return seg.anchors(stage_segments(d), 2, 10).select("demo_id", "s0", "s1", "s")


@query("w12_viewer_starts", f"""
with {STAGE_CTE} select demo_id, s0::int as s0, s1::int as s1, unnest(range(s0, s1, 20))::int as s from sg""")
def viewer_starts(d: Data):
    return seg.anchors(stage_segments(d), 20, 1, inclusive=True).select("demo_id", "s0", "s1", "s")


def keyframe_sql(starts: str, k: int = K, gs: float = 1.2, ge: float = 1.6) -> str:
    """SQL for the k keyframe indices of every (demo_id, s, e) of ``starts``."""
    u = f"(k / {k - 1}.0)"
    w = f"case when {u} <= 0.5 then 0.5 * pow(2.0 * {u}, {gs}) else 1.0 - 0.5 * pow(2.0 * (1.0 - {u}), {ge}) end"
    return f"""
select demo_id, s, e, k, case when e <= s then s when n_uniq < {int(0.7 * k)} then flat else warped end::int as t from (
 select *, count(distinct warped) over (partition by demo_id, s, e) as n_uniq from (
  select demo_id, s, e, k, case when k = 0 then s when k = {k - 1} then e else round_even(s + (e - s) * ({w}), 0) end::int as warped,
    case when k = 0 then s when k = {k - 1} then e else round_even(s + (e - s) * {u}, 0) end::int as flat
  from ({starts}) cross join (select unnest(range({k}))::int as k)))"""


@query("w13_resample", f"with {STAGE_CTE}, st as (select demo_id, unnest(range(s0, s1))::int as s, (s1 - 1)::int as e from sg) "
       + keyframe_sql("select * from st"))
def resample(d: Data):
    st = seg.anchors(stage_segments(d), 1, 1, inclusive=True).select("demo_id", "s", (F.col("s1") - 1).alias("e"))
    idx = seg.resample_indices(F.col("s"), F.col("e"), K)
    return st.select("demo_id", "s", "e", F.posexplode(idx).alias("k", "t"))


SEGEND = """select demo_id, s, max(e) as e from (
 select f.demo_id, f.t as s, (g.s1 - 1)::int as e from fx_steps f join fx_segments g on f.demo_id = g.demo_id and f.t >= g.s0 and f.t < g.s1)
 group by all"""


def keyframes(d: Data, k: int = K, limit_tail: bool = False):
    frames = d.frames().select("demo_id", "t")
    ends = seg.segment_end_of(frames, policy_segments(d)).withColumnRenamed("t", "s")
    if limit_tail:
        ends = ends.join(d.demo().select("demo_id", "t_len"), "demo_id").filter(F.col("s") <= F.col("t_len") - 1 - k)
    return ends.select("demo_id", "s", F.posexplode(seg.resample_indices(F.col("s"), F.col("seg_end"), k)).alias("k", "t"))


@query("w14_keyframe_targets", f"""
with key as (select * from ({keyframe_sql(SEGEND)}) join fx_demo using (demo_id) where s <= t_len - 1 - {K})
select demo_id, s, count(*)::bigint as n, sum((k + 1) * tr.xu)::bigint as wx, sum((k + 1) * tr.yu)::bigint as wy,
  sum((k + 1) * (point_id + 1) * tr.zu)::bigint as wz
from key join fx_tracks tr using (demo_id, t) group by demo_id, s""")
def keyframe_targets(d: Data):
    # one row per (start, keyframe) meets the frame; then its points are written out
    g = d.tracks(keyframes(d, limit_tail=True))
    return g.groupBy("demo_id", "s").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("k") + 1) * F.col("xu")).alias("wx"),
        F.sum((F.col("k") + 1) * F.col("yu")).alias("wy"),
        F.sum((F.col("k") + 1) * (F.col("point_id") + 1) * F.col("zu")).alias("wz"))


@query("j18_segment_of", """
with good as (select demo_id, s0, s1 from fx_segments where s1 - s0 >= 10),
 edge as (select demo_id, min(s0) as f0, arg_min(s1, s0) as f1, arg_max(s1, s0) as l1 from good group by 1)
select f.demo_id, f.t, (case when f.t < f0 then f1 else coalesce(g.s1, l1) end - 1)::int as seg_end
from fx_steps f join edge using (demo_id) left join good g on g.demo_id = f.demo_id and f.t >= g.s0 and f.t < g.s1""")
def segment_of(d: Data):
    # short segments are dropped first, so that frames in gaps exist
    good = seg.segments(signal(d), "state", 3, 10, d.demo(), "viewer")
    return seg.segment_end_of(d.steps().select("demo_id", "t"), good)


@query("j04_gather_keyframes", f"""
with key as ({keyframe_sql("select demo_id, t as s, (t + 9)::int as e from fx_steps")})
select demo_id, s, k, least(key.t, t_len - 1)::int as t, count(*)::bigint as n, sum(tr.xu * (point_id + 1))::bigint as wx,
  sum(tr.yu)::bigint as sy, sum(tr.zu)::bigint as sz
from key join fx_demo using (demo_id) join fx_tracks tr using (demo_id) where tr.t = least(key.t, t_len - 1) group by all""")
def gather_keyframes(d: Data):
    key = d.steps().select("demo_id", F.col("t").alias("s")).select("demo_id", "s", F.posexplode(
        seg.resample_indices(F.col("s"), F.col("s") + 9, K)).alias("k", "t"))
    key = key.join(d.demo().select("demo_id", "t_len"), "demo_id")
    key = key.withColumn("t", F.greatest(F.least("t", F.col("t_len") - 1), F.lit(0))).drop("t_len")
    return d.tracks(key).groupBy("demo_id", "s", "k", "t").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("xu") * (F.col("point_id") + 1)).alias("wx"),
        F.sum("yu").alias("sy"), F.sum("zu").alias("sz"))


@query("w16_endpoint_lerp", f"""
with {STAGE_CTE} select f.demo_id, f.t, {q6('(f.t - s0) / greatest(s1 - s0 - 1, 1)')} as w
from fx_steps f join sg on f.demo_id = sg.demo_id and f.t >= s0 and f.t < s1""")
def endpoint_lerp(d: Data):
    hit = seg.join_interval(d.steps().select("demo_id", "t"), stage_segments(d))
    return hit.select("demo_id", "t", r6((F.col("t") - F.col("s0")) / F.greatest(F.col("s1") - F.col("s0") - 1, F.lit(1))).alias("w"))


@query("h28_manifest", f"""
with {STAGE_CTE} select task, demo_id, s0::int as s0, concat('{{"seg":[', s0, ',', s1, '],"starts":[',
  array_to_string(range(s0, s1, 20), ','), '],"n_frames":', s1 - s0, '}}') as entry
from sg join fx_demo using (demo_id)""")
def manifest(d: Data):
    # one JSON text per segment: an entry grows with its segment, a demo or task would gather all of them
    s = stage_segments(d).join(d.demo().select("demo_id", "task"), "demo_id")
    starts = F.sequence("s0", F.col("s1") - 1, F.lit(20))
    entry = F.to_json(F.struct(F.array("s0", "s1").alias("seg"), starts.alias("starts"), (F.col("s1") - F.col("s0")).alias("n_frames")))
    return s.select("task", "demo_id", "s0", entry.alias("entry"))


@query("h28_manifest_nested", f"""
with {STAGE_CTE}, e as (select task, demo_id, s0, s1 - s0 as n, concat('{{"seg":[', s0, ',', s1, '],"starts":[', array_to_string(range(s0, s1, 20), ','), ']}}') as entry
   from sg join fx_demo using (demo_id)),
 w as (select *, count(*) over d as dn, sum(n) over d as df, count(*) over k as tn, sum(n) over k as tf, s0 = min(s0) over d as o, s0 = max(s0) over d as c,
   demo_id = min(demo_id) over k as fd, demo_id = max(demo_id) over k as ld from e window d as (partition by task, demo_id), k as (partition by task)),
 td as (select task, count(distinct demo_id) as nd from e group by task)
select concat(case when o and fd then concat('{{"task":"', task, '","n_demos":', nd, ',"n_segments":', tn, ',"n_frames":', tf, ',"demos":[') else ',' end,
  case when o then concat('{{"demo_id":', demo_id, ',"n_segments":', dn, ',"n_frames":', df, ',"segments":[') else '' end, entry,
  case when c then ']}}' else '' end, case when c and ld then ']}}' else '' end) as line from w join td using (task)""")
def nested_manifest(d: Data):
    s = stage_segments(d).join(d.demo().select("demo_id", "task"), "demo_id")
    entry = F.to_json(F.struct(F.array("s0", "s1").alias("seg"), F.sequence("s0", F.col("s1") - 1, F.lit(20)).alias("starts")))
    rows = materialize(s.select("task", "demo_id", "s0", (F.col("s1") - F.col("s0")).alias("n_frames"), entry.alias("entry")), "manifest-rows")
    path = scratch_dir(d.spark, "manifest")
    write_nested(rows, path)
    return d.spark.read.text(path).withColumnRenamed("value", "line")
