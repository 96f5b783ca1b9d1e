"""Scans, sinks, catalogs, variants and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathweave import schemas
from pathweave.functions.arrays import channels_last
from pathweave.operators.motion import forward_flow
from pathweave.operators.sequence import first_n
from pathweave.plans.fixtures import Data
from pathweave.plans.registry import query
from pathweave.plans.segments import K, SEGEND, keyframe_sql, keyframes
from pathweave.session import scratch_dir
from pathweave.sources import tables as io
from pathweave.sources.catalog import inspect_tables


@query("s01_scan_tracks", """
select 'orders' as tbl, count(*)::bigint as n from orders union all select 'lineitem', count(*)::bigint from lineitem""")
def scan_tracks(d: Data):
    # explicit files and a glob that reach the same files: each counts once
    df = io.scan(d.spark, [f"{d.dir}/orders.parquet", f"{d.dir}/*item.parquet", f"{d.dir}/lineitem.parquet"], "*.parquet", [])
    return df.groupBy(F.regexp_extract("file", r"([^/]+)\.parquet$", 1).alias("tbl")).agg(F.count(F.lit(1)).alias("n"))


@query("s02_read_keys", "select event_id, value from events")
def read_keys(d: Data):
    return d.table("events").select("event_id", "value")


@query("s04_step_logs", """
with l as (select event_id, regexp_extract(props, '(\\d+)', 1)::int as k from events)
select event_id, unnest(range(k % 4))::int as step, k / 2.0 as gripper, 3 as n_joints from l where k % 4 > 0""")
def step_logs(d: Data):
    k = F.get_json_object("props", "$.k").cast("int")
    step = F.concat(F.lit('{"joints":[0.1,0.2,0.3],"gripper":'), (k / 2.0).cast("string"), F.lit("}"))
    raw = F.when(k % 4 == 0, F.lit('{"not":"a list"}')).otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(step, k % 4), ","), F.lit("]")))
    log = d.table("events").select("event_id", F.from_json(raw, schemas.STEP_LOG).alias("log")).filter(F.size("log") > 0)
    out = log.select("event_id", F.posexplode("log").alias("step", "s"))
    return out.select("event_id", "step", F.col("s.gripper").alias("gripper"), F.size("s.joints").alias("n_joints")).filter("n_joints > 0")


@query("s05_mapping_csv", "select lower(trim(n_name)) as key, 'go to ' || n_name as prompt from nation")
def mapping_csv(d: Data):
    path = scratch_dir(d.spark, "mapping")
    d.table("nation").select(F.col("n_name").alias("Base_Name"), F.concat(F.lit("go to "), "n_name").alias("PROMPT")).write.option("header", True).csv(path)
    csv = d.spark.read.option("header", True).csv(path)
    csv = csv.toDF(*[c.lower() for c in csv.columns])
    return csv.select(F.lower(F.trim("base_name")).alias("key"), F.trim("prompt").alias("prompt"))


@query("s06_explode_episode", """
with c as (select *, length(text) % 3 <> 0 or conv_id % 2 = 0 as has_frame from conversations)
select conv_id, turn, role, bool_and(has_frame) over (partition by conv_id) as frames_complete, first_instr from c
join (select conv_id, arg_min(text, turn) filter (role = 'user' and trim(text) <> '') as first_instr from conversations group by 1) using (conv_id)""")
def explode_episode(d: Data):
    # the nested form such sources deliver: arrays of steps, a long episode in shards of 64 steps
    step = F.struct("turn", "role", "text", F.when((F.length("text") % 3 != 0) | (F.col("conv_id") % 2 == 0), F.lit(1)).alias("frame"))
    nested = d.table("conversations").groupBy("conv_id", F.floor(F.col("turn") / 64).alias("shard")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    complete = F.forall("steps", lambda s: s["frame"].isNotNull())
    instr = F.get(F.filter("steps", lambda s: (s["role"] == "user") & (F.trim(s["text"]) != "")), F.lit(0))["text"]
    per = nested.groupBy("conv_id").agg(F.bool_and(complete).alias("frames_complete"),
                                        F.min_by(instr, F.when(instr.isNotNull(), F.col("shard"))).alias("first_instr"))
    rows = nested.select("conv_id", F.inline("steps")).select("conv_id", "turn", "role")
    return rows.join(per, "conv_id")


@query("s09_write_variant", """
select 'filtered' as variant, count(*)::bigint as n, sum(xu + 1)::bigint as sx, false as second_write, false as dry from fx_tracks union all select 'raw', count(*)::bigint, sum(xu)::bigint, false, false from fx_tracks""")
def write_variant(d: Data):
    path = scratch_dir(d.spark, "variants")
    tr = d.tracks().select("demo_id", "t", "point_id", "xu")
    io.write_variant(tr, path, "raw")
    plus = tr.withColumn("xu", F.col("xu") + 1)
    io.write_variant(tr, path, "filtered")
    io.write_variant(plus, path, "filtered", mode="replace")
    again = io.write_variant(tr, path, "raw", mode="skip")
    dry = io.write_variant(tr, path, "other", dry_run=True)
    return io.read_variant(d.spark, path).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("xu").alias("sx")).withColumns(
        {"second_write": F.lit(again), "dry": F.lit(dry)})


@query("s11_write_report", "select demo_id, suite, t_len from fx_demo")
def write_report(d: Data):
    path = scratch_dir(d.spark, "report")
    io.write_report(d.demo(), path + ".csv", ["demo_id", "suite", "t_len"])
    io.write_report(d.demo(), path + ".json", ["demo_id", "suite", "t_len"], fmt="json")
    csv = d.spark.read.schema("demo_id bigint, suite string, t_len int").option("header", True).csv(path + ".csv")
    js = d.spark.read.schema("demo_id bigint, suite string, t_len int").json(path + ".json")
    return csv.intersect(js)


@query("s12_export_episodes", """
select demo_id, t, value as state, coalesce(lead(value) over (partition by demo_id order by t), value) as action, task from fx_steps join fx_demo using (demo_id)""")
def export_episodes(d: Data):
    from pathweave.operators.sequence import over_neighbours
    s = over_neighbours(d.steps().select("demo_id", "t", "value"), ["demo_id"], "t", lambda w: {"action": F.coalesce(F.lead("value").over(w), F.col("value"))}, 0, 1)
    out = s.join(d.demo().select("demo_id", "task"), "demo_id").withColumnRenamed("value", "state")
    path = scratch_dir(d.spark, "episodes")
    out.repartition("task", F.floor(F.col("t") / 1024)).sortWithinPartitions("demo_id", "t").write.partitionBy("task").parquet(path)
    return d.spark.read.parquet(path)


@query("s13_export_flows", """
with w as (select demo_id, point_id, t, lead(xu) over (partition by demo_id, point_id order by t) - xu as f from fx_tracks)
select demo_id, (max(t) + 1)::int as n_frames, count(distinct point_id)::bigint as n_points, coalesce(sum(f), 0)::bigint as flow_sum from w group by demo_id""")
def export_flows(d: Data):
    path = scratch_dir(d.spark, "flows")
    forward_flow(d.tracks()).write.parquet(path)
    f = d.spark.read.parquet(path)
    return f.groupBy("demo_id").agg((F.max("t") + 1).alias("n_frames"), F.count_distinct("point_id").alias("n_points"), F.sum("dxu").alias("flow_sum"))


@query("s14_training_cache", f"""
with key as (select * from ({keyframe_sql(SEGEND)}) join fx_demo using (demo_id) where s <= t_len - 1 - {K}),
 tg as (select demo_id, s, string_agg(key.t::varchar, ',' order by k) as target from key group by 1, 2)
select suite, task, f.demo_id, f.t::int as t, f.grip::int as grip, f.value::float::double as value, coalesce(target, '') as target, 1 as cache_version from fx_steps f join fx_demo using (demo_id) left join tg on tg.demo_id = f.demo_id and tg.s = f.t""")
def training_cache(d: Data):
    tg = keyframes(d, limit_tail=True).groupBy("demo_id", "s").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("kt"))  # K entries
    tg = tg.select("demo_id", F.col("s").alias("t"), F.array_join(F.col("kt.t").cast("array<string>"), ",").alias("target"))
    base = d.steps().select("demo_id", "t", F.col("grip").cast("int").alias("grip"), F.col("value").cast("float").cast("double").alias("value"))
    out = base.join(d.demo().select("demo_id", "suite", "task"), "demo_id").join(tg, ["demo_id", "t"], "left").withColumns(
        {"target": F.coalesce("target", F.lit("")), "cache_version": F.lit(1)})
    path = scratch_dir(d.spark, "cache")
    out.repartition("suite", "task", F.floor(F.col("t") / 1024)).sortWithinPartitions("demo_id", "t").write.partitionBy("suite", "task").parquet(path)
    return d.spark.read.parquet(path)


@query("s15_skip_existing", "select o_orderkey, 1::bigint as n from orders where o_orderstatus <> 'F' union all select -1, count(*)::bigint from orders where o_orderstatus = 'F'")
def skip_existing(d: Data):
    """The inputs still to do, and one row (key -1) with the number that was skipped."""
    o = d.table("orders")
    done = o.filter("o_orderstatus = 'F'").select("o_orderkey")
    skipped = o.join(done, "o_orderkey", "left_semi").agg(F.lit(-1).cast("bigint").alias("o_orderkey"), F.count(F.lit(1)).alias("n"))
    return io.only_new(o, done, ["o_orderkey"]).select("o_orderkey", F.lit(1).cast("bigint").alias("n")).unionByName(skipped)


VARS = """select demo_id, t, point_id, v.variant, xu + v.o as xu from fx_tracks cross join (select 'point_traj' as variant, 0 as o union all select 'point_traj_metric', 1 union all select 'point_traj_stage', 2) v where not (v.o = 1 and demo_id % 9 = 2) and not (v.o = 2 and demo_id % 7 = 3)"""


def variant_rows(d: Data):
    v = F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(o).alias("o")) for o, n in enumerate(("point_traj", "point_traj_metric", "point_traj_stage"))]))
    r = d.tracks().select("demo_id", "t", "point_id", "xu", v)
    r = r.filter(~((F.col("o") == 1) & (F.col("demo_id") % 9 == 2)) & ~((F.col("o") == 2) & (F.col("demo_id") % 7 == 3)))
    return r.select("demo_id", "t", "point_id", "variant", (F.col("xu") + F.col("o")).alias("xu"))


@query("s16_clean_export", f"""
with v as ({VARS}), ok as (select demo_id from v where variant in ('point_traj_metric', 'point_traj_stage') group by 1 having count(distinct variant) = 2)
select demo_id, case variant when 'point_traj_metric' then 'global_metric' else 'stage_metric' end as variant, count(*)::bigint as n, sum(xu)::bigint as sx from v where demo_id in (select demo_id from ok) and variant <> 'point_traj' group by 1, 2""")
def clean_export(d: Data):
    v = variant_rows(d)
    publish = v.filter(F.col("variant").isin("point_traj_metric", "point_traj_stage"))
    # a row per demo and variant first: whether a demo has both is then read from these few, and no point is moved for it
    g = publish.groupBy("demo_id", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum("xu").alias("sx"))
    both = g.groupBy("demo_id").agg(F.collect_list(F.struct("variant", "n", "sx")).alias("v")).filter(F.size("v") == 2)
    out = both.select("demo_id", F.inline("v"))
    return out.select("demo_id", F.when(F.col("variant") == "point_traj_metric", "global_metric").otherwise("stage_metric").alias("variant"), "n", "sx")


@query("s17_subset_demo", f"""
with v as ({VARS}) select demo_id, 'active' as variant, count(*)::bigint as n, sum(xu)::bigint as sx from v where demo_id = (select min(demo_id) from v) and variant = 'point_traj' group by 1""")
def subset_demo(d: Data):
    v = variant_rows(d)
    one = d.demo().agg(F.min("demo_id").alias("demo_id"))  # one row
    out = v.filter("variant = 'point_traj'").join(one, "demo_id", "left_semi").withColumn("variant", F.lit("active"))
    return out.groupBy("demo_id", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum("xu").alias("sx"))


@query("s18_set_lineage", """
select demo_id, unnest(['mode', 't_len', 'units']) as name, unnest(['stage', t_len::varchar, 'm']) as value from fx_demo""")
def set_lineage(d: Data):
    return io.attributes(d.demo(), "demo_id", mode=F.lit("stage"), t_len=F.col("t_len"), units=F.lit("m"))


@query("s19_inspect_catalog", """
select key_name, count(*)::bigint as n_demos, sum(size_n)::bigint as total_size, min(size_n)::bigint as min_size, max(size_n)::bigint as max_size from fx_catalog group by key_name""")
def inspect_catalog(d: Data):
    return d.catalog().groupBy("key_name").agg(F.count(F.lit(1)).alias("n_demos"), F.sum("size_n").alias("total_size"),
                                               F.min("size_n").cast("bigint").alias("min_size"), F.max("size_n").cast("bigint").alias("max_size"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def described_sql(t: str) -> str:
    return f"""select '{t}' as tbl, s.column_name as "column", case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double'
   when 'FLOAT[]' then 'array<float>' else 'timestamp_ntz' end as dtype, s.count::bigint as n_rows, case when column_type not like '%]' then n end as n_values,
   case when column_type in ('INTEGER', 'BIGINT') then s.min end::bigint as lo, case when column_type in ('INTEGER', 'BIGINT') then s.max end::bigint as hi
 from (summarize {t}) s join (from (unpivot (select count(columns(*)) as '\\0' from {t}) on columns(*) into name c value n)) on c = s.column_name"""


@query("s19_inspect_tables", " union all ".join(described_sql(t) for t in TABLES))
def inspect_given(d: Data):
    found = inspect_tables(d.spark, {t: f"{d.dir}/{t}.parquet" for t in TABLES})
    return found.select("tbl", "column", "dtype", "n_rows", "n_values", "lo", "hi")


@query("s20_merge_source_columns", """
with src as (select s.demo_id, s.t, s.event_id from fx_steps s join fx_demo using (demo_id) where s.t < t_len - demo_id % 4)
select f.demo_id, f.t, f.grip, src.event_id as src_event from fx_steps f join (select demo_id, max(t) as mt from src group by 1) using (demo_id) join src on src.demo_id = f.demo_id and src.t = least(f.t, mt)""")
def merge_source(d: Data):
    n = d.demo().select("demo_id", "t_len")
    src = d.steps().join(n, "demo_id").filter(F.col("t") < F.col("t_len") - F.col("demo_id") % 4).select("demo_id", F.col("t").alias("st"), F.col("event_id").alias("src_event"))
    last = src.groupBy("demo_id").agg(F.max("st").alias("mt"))
    f = d.steps().select("demo_id", "t", "grip").join(last, "demo_id").withColumn("st", F.least("t", "mt"))
    return f.join(src, ["demo_id", "st"]).select("demo_id", "t", "grip", "src_event")


@query("s21_backup_variant", f"""
with v as ({VARS}) select demo_id, count(*)::bigint as n from v where variant = 'point_traj' and demo_id not in (select demo_id from v where variant = 'point_traj_stage') and demo_id % 5 <> 1 group by 1""")
def backup(d: Data):
    # demos whose active data is metric already need no copy of the original
    b = io.backup_variant(variant_rows(d), "point_traj", "point_traj_stage", skip_if=F.col("demo_id") % 5 == 1)
    return b.groupBy("demo_id").agg(F.count(F.lit(1)).alias("n"))


@query("s22_activate_variant", f"""
with v as ({VARS}), has as (select distinct demo_id from v where variant = 'point_traj_metric')
select demo_id, variant, count(*)::bigint as n, sum(xu)::bigint as sx from (select * from v where variant <> 'point_traj' or demo_id not in (select demo_id from has)
 union all select demo_id, t, point_id, 'point_traj', xu from v where variant = 'point_traj_metric') group by 1, 2""")
def activate(d: Data):
    a = io.activate_variant(variant_rows(d), "point_traj_metric", "point_traj")
    return a.groupBy("demo_id", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum("xu").alias("sx"))


@query("p03_first_existing", """
select demo_id, arg_min(key_name, case key_name when 'point_traj_metric' then 0 when 'point_traj' then 1 else 2 end) as chosen from fx_catalog where key_name in ('point_traj_metric', 'point_traj', 'track2d') and size_n > 0 group by demo_id""")
def first_existing(d: Data):
    want = F.array(*[F.lit(k) for k in ("point_traj_metric", "point_traj", "track2d")])
    c = d.catalog().withColumn("prio", F.array_position(want, F.col("key_name"))).filter((F.col("prio") > 0) & (F.col("size_n") > 0))
    return c.groupBy("demo_id").agg(F.min_by("key_name", "prio").alias("chosen"))


@query("p08_has_tracks", "select demo_id from fx_demo where coalesce(case when demo_id % 5 = 0 then null else demo_id % 3 > 0 end, true)")
def has_tracks(d: Data):
    flag = F.when(F.col("demo_id") % 5 != 0, F.col("demo_id") % 3 > 0)
    return d.demo().filter(F.coalesce(flag, F.lit(True))).select("demo_id")


@query("p10_flatten_unflatten", """
select demo_id, t, string_agg(xu::varchar, ',' order by point_id) as xs, count(*)::bigint as n from fx_tracks group by demo_id, t""")
def flatten_unflatten(d: Data):
    # rows to one array per frame, back to rows, and to arrays again
    def pack(r):
        return r.groupBy("demo_id", "t").agg(F.array_sort(F.collect_list(F.struct("point_id", "xu"))).alias("p"))
    rows = pack(d.tracks()).select("demo_id", "t", F.inline("p"))
    p = pack(rows)
    return p.select("demo_id", "t", F.array_join(F.col("p.xu").cast("array<string>"), ",").alias("xs"), F.size("p").cast("bigint").alias("n"))


@query("p10_channel_layouts", """
with e as (select event_id, event_id % 6 as kind, unnest(range(10)) as p from events),
 c as (select *, unnest(range(3)) as c from e),
 i as (select *, case kind when 0 then p * 3 + c when 1 then p * 4 + c when 2 then c * 10 + p when 3 then p when 4 then p end as i from c)
select event_id, case when kind < 5 then string_agg(((event_id * 31 + i * 7) % 256)::varchar, ',' order by p, c) end as pixels from i group by event_id, kind""")
def channel_layouts(d: Data):
    shapes = ([2, 5, 3], [2, 5, 4], [3, 2, 5], [2, 5], [1, 2, 5, 1], [2, 5, 2])
    shape = F.get(F.array(*[F.array(*map(F.lit, s)) for s in shapes]), (F.col("event_id") % 6).cast("int"))
    size = F.aggregate("shape", F.lit(1), lambda a, n: a * n)
    e = d.table("events").select("event_id", shape.alias("shape"))
    e = e.withColumn("v", F.transform(F.sequence(F.lit(0), size - 1), lambda i: (F.col("event_id") * 31 + i * 7) % 256))
    return e.select("event_id", F.array_join(channels_last(F.col("v"), F.col("shape")).cast("array<string>"), ",").alias("pixels"))


@query("p11_valid_shape", """
select demo_id, bool_and(n = 24) and count(*) >= 2 as valid from (select demo_id, t, count(*) filter ((demo_id + t) % 401 <> 0 or point_id > 0) as n from fx_tracks group by 1, 2) group by demo_id""")
def valid_shape(d: Data):
    per = d.tracks().groupBy("demo_id", "t").agg(F.count_if(((F.col("demo_id") + F.col("t")) % 401 != 0) | (F.col("point_id") > 0)).alias("n"))
    return per.groupBy("demo_id").agg((F.bool_and(F.col("n") == 24) & (F.count(F.lit(1)) >= 2)).alias("valid"))


@query("p15_drop_prefix_columns", "select demo_id, key_name from fx_catalog where key_name not like 'point\\_traj%' escape '\\'")
def drop_prefix(d: Data):
    return d.catalog().filter(~F.col("key_name").startswith("point_traj")).select("demo_id", "key_name")


@query("p16_modes_available", """
select demo_id, string_agg(key_name, ',' order by kid) as modes from fx_catalog where key_name like 'point%' group by demo_id""")
def modes_available(d: Data):
    c = d.catalog().filter(F.col("key_name").startswith("point")).groupBy("demo_id").agg(F.array_sort(F.collect_set(F.struct("kid", "key_name"))).alias("m"))  # few known keys
    return c.select("demo_id", F.array_join(F.col("m.key_name"), ",").alias("modes"))


@query("p22_coordinate_frame", """
select demo_id, coalesce(case when demo_id % 3 = 0 then 'world' end, case when demo_id % 4 = 0 then 'camera' end, 'robot0_base') as frame from fx_demo""")
def coordinate_frame(d: Data):
    a = F.when(F.col("demo_id") % 3 == 0, "world")
    b = F.when(F.col("demo_id") % 4 == 0, "camera")
    return d.demo().select("demo_id", F.coalesce(a, b, F.lit("robot0_base")).alias("frame"))


@query("j02_match_episode", """
with raw as (select p_partkey as raw_id from part where p_partkey % 3 <> 1), c as (select s_suppkey, s_suppkey * 3 % 250 as want from supplier)
select s_suppkey, raw_id from c join raw on raw_id = want union all select s_suppkey, -1 from c where want not in (select raw_id from raw)""")
def match_episode(d: Data):
    raw = d.table("part").filter("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("raw_id"))
    c = d.table("supplier").select("s_suppkey", F.substring_index(F.concat(F.lit("demo_"), F.col("s_suppkey") * 3 % 250), "_", -1).cast("bigint").alias("raw_id"))
    hit = c.join(raw, "raw_id").select("s_suppkey", "raw_id")
    miss = c.join(raw, "raw_id", "left_anti").select("s_suppkey", F.lit(-1).cast("bigint").alias("raw_id"))
    return hit.unionByName(miss)


@query("j02_match_raw", """
with raw as (select file, p_partkey as raw_id, row_number() over (partition by file order by p_partkey) - 1 as at, count(*) over (partition by file) as n
   from (select p_partkey, case when p_partkey % 2 = 0 then p_partkey % 20 else 1000 + p_partkey end as file from part)),
 de as (select file, c_custkey, case when c_custkey % 7 = 0 then row_number() over (partition by file order by c_custkey) - 1 else (c_custkey * 3) // 20 end as num
   from (select c_custkey, case when c_custkey % 3 = 0 then 1000 + c_custkey else c_custkey % 20 end as file from customer))
select file, c_custkey as demo, raw_id from de join raw using (file) where n = 1 or raw.at = de.num""")
def match_raw(d: Data):
    # odd parts are alone in their file; some customers' names end without a number, some files have no raw trajectory
    p, c = F.col("p_partkey"), F.col("c_custkey")
    raws = d.table("part").select(F.when(p % 2 == 0, p % 20).otherwise(p + 1000).alias("file"), p.alias("raw_id"))
    name = F.when(c % 7 == 0, "demo_final").otherwise(F.concat(F.lit("demo_"), F.floor(c * 3 / 20)))
    demos = d.table("customer").select(F.when(c % 3 == 0, c + 1000).otherwise(c % 20).alias("file"), c.alias("demo"), name.alias("name"))
    return io.match_raw(demos, raws)


@query("j03_concat_state", """
select f.demo_id, f.t, concat_ws(',', f.event_id, f.t, g.grip) as ee_grip, case when f.event_id % 5 = 0 then '' else concat_ws(',', f.event_id * 2, g.grip) end as joint_grip from fx_steps f join fx_steps g using (demo_id, t)""")
def concat_state(d: Data):
    s = d.steps()
    ee = s.select("demo_id", "t", F.array(F.col("event_id"), F.col("t").cast("bigint")).alias("ee"), F.when(F.col("event_id") % 5 != 0, F.array(F.col("event_id") * 2)).alias("joint"))
    g = s.select("demo_id", "t", F.array(F.col("grip").cast("bigint")).alias("g"))
    j = ee.join(g, ["demo_id", "t"])
    return j.select("demo_id", "t", F.array_join(F.concat("ee", "g").cast("array<string>"), ",").alias("ee_grip"),
                    F.coalesce(F.array_join(F.concat("joint", "g").cast("array<string>"), ","), F.lit("")).alias("joint_grip"))


REQ = ("actions", "frames_rgb", "point_traj", "track2d", "vis")


def missing(d: Data):
    req = F.posexplode(F.array(*[F.lit(k) for k in REQ])).alias("ord", "key_name")
    want = d.demo().select("demo_id", "task", req)
    j = want.join(d.catalog().select("demo_id", "key_name", "size_n"), ["demo_id", "key_name"], "left")
    why = F.when(F.col("size_n").isNull(), F.concat(F.lit("missing:"), "key_name")).when(F.col("size_n") == 0, F.concat(F.lit("empty:"), "key_name"))
    return j.withColumn("why", why)


MISSING = """select demo_id, task, r.ord, r.key_name, case when c.size_n is null then 'missing:' || r.key_name when c.size_n = 0 then 'empty:' || r.key_name end as why
from fx_demo cross join (select unnest(range(5)) as ord, unnest(['actions', 'frames_rgb', 'point_traj', 'track2d', 'vis']) as key_name) r left join fx_catalog c using (demo_id, key_name)"""


@query("j06_missing_keys", f"select demo_id, coalesce(string_agg(why, ',' order by ord), '') as reasons from ({MISSING}) group by demo_id")
def missing_keys(d: Data):
    g = missing(d).groupBy("demo_id").agg(F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("ord", "why")))).alias("w"))  # as many as required keys
    return g.select("demo_id", F.array_join(F.col("w.why"), ",").alias("reasons"))


@query("a50_demo_verdict", f"""
with b as (select demo_id, count(why) as n from ({MISSING}) group by 1)
select demo_id, case when n = 0 then 'keep' when n = 1 then 'report' else 'delete' end as action, n < 2 as published from b""")
def demo_verdict(d: Data):
    b = missing(d).groupBy("demo_id").agg(F.count("why").alias("n"))
    v = b.select("demo_id", F.when(F.col("n") == 0, "keep").when(F.col("n") == 1, "report").otherwise("delete").alias("action"))
    gone = v.filter("action = 'delete'").select("demo_id")
    kept = d.demo().join(gone, "demo_id", "left_anti").select("demo_id", F.lit(True).alias("published"))
    return v.join(kept, "demo_id", "left").withColumn("published", F.coalesce("published", F.lit(False)))


@query("a11_file_summary", f"""
with b as (select demo_id, task as file, count(why) as n from ({MISSING}) group by 1, 2)
select file, count(*)::bigint as demos, count(*) filter (n > 0)::bigint as bad, bool_or(n > 0) as any_bad from b group by file""")
def file_summary(d: Data):
    b = missing(d).groupBy("demo_id", "task").agg(F.count("why").alias("n"))
    return b.groupBy(F.col("task").alias("file")).agg(F.count(F.lit(1)).alias("demos"), F.count_if(F.col("n") > 0).alias("bad"), F.bool_or(F.col("n") > 0).alias("any_bad")).orderBy(F.desc("bad"), "file")


@query("a12_status_counts", f"""
with b as (select demo_id, task as file, case when count(why) = 0 then 'ok' else 'bad' end as status from ({MISSING}) group by 1, 2)
select coalesce(file, 'total') as file, status, count(*)::bigint as n from b group by grouping sets ((file, status), (status))""")
def status_counts(d: Data):
    b = missing(d).groupBy("demo_id", "task").agg(F.when(F.count("why") == 0, "ok").otherwise("bad").alias("status"))
    g = b.groupingSets([[F.col("task"), F.col("status")], [F.col("status")]], F.col("task"), F.col("status")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("task", F.lit("total")).alias("file"), "status", "n")


@query("t01_worst_files", f"""
select demo_id, count(why)::bigint as n_bad from ({MISSING}) group by 1 having count(why) > 0 order by n_bad desc, demo_id limit 30""")
def worst_files(d: Data):
    g = missing(d).groupBy("demo_id").agg(F.count("why").alias("n_bad")).filter("n_bad > 0")
    return g.orderBy(F.desc("n_bad"), "demo_id").limit(30)


@query("t02_topk_per_group", f"""
select file, demo_id, why from (select task as file, demo_id, why, row_number() over (partition by task order by demo_id, ord) as r from ({MISSING}) where why is not null) where r <= 3""")
def topk(d: Data):
    m = missing(d).filter("why is not null")
    return first_n(m, ["task"], [F.col("demo_id"), F.col("ord")], 3, salt_by=["demo_id"]).select(F.col("task").alias("file"), "demo_id", "why")


@query("t04_limit_files", "select demo_id, t_len from fx_demo order by demo_id limit 7")
def limit_files(d: Data):
    return d.demo().select("demo_id", "t_len").orderBy("demo_id").limit(7)


@query("t07_cap_per_class", """
with r as (select *, row_number() over (partition by task_id, success order by init_id) as k from fx_rollout) select task_id, init_id, success from r where success = 0 or k <= 5""")
def cap_per_class(d: Data, n_success: int = 5, n_fail: int = -1):
    r = d.rollout()
    limit = {1: n_success, 0: n_fail}
    parts = []
    for flag, n in limit.items():  # a negative cap means all
        c = r.filter(F.col("success") == flag)
        parts.append(c if n < 0 else first_n(c, ["task_id", "success"], [F.col("init_id")], n, salt_by=["init_id"]).drop("rank"))
    return parts[0].unionByName(parts[1]).select("task_id", "init_id", "success")


@query("j19_infer_stride", """
with track as (select demo_id, 1 + demo_id % 4 as st from fx_demo), tl as (select d.demo_id, case when demo_id % 11 = 0 then t_len - 3 else (t_len + st - 1) // st end as n, st, t_len from fx_demo d join track using (demo_id))
select demo_id, case when n = t_len then 'same_length' when demo_id % 11 <> 0 then case when demo_id % 5 = 0 then 'inferred_stride_' || st else 'matched_actions_stride_' || st end else 'linspace_fallback' end as method from tl""")
def infer_stride(d: Data):
    n, _, _ = strided(d)
    return n.select("demo_id", "method")


def strided(d: Data):
    """The track's actions are every st-th action of the source (spoilt for some demos); the stride is found again.

    Returns one row per demo (n, t_len, method, stride: null for linspace), the track's rows and those of the source.
    """
    src = d.steps().select("demo_id", "t", F.col("value").alias("a")).join(d.demo().select("demo_id", "t_len"), "demo_id")
    st = 1 + F.col("demo_id") % 4
    odd = F.col("demo_id") % 11 == 0
    tr = src.filter((~odd & (F.col("t") % st == 0)) | (odd & (F.col("t") < F.col("t_len") - 3)))
    tr = tr.select("demo_id", F.when(odd, F.col("t")).otherwise(F.floor(F.col("t") / st)).cast("int").alias("i"),
                   (F.col("a") + F.when(F.col("demo_id") % 5 == 0, 1.0).otherwise(0.0)).alias("b"))
    n = tr.groupBy("demo_id").agg(F.count(F.lit(1)).alias("n")).join(d.demo().select("demo_id", "t_len"), "demo_id")
    cand = n.withColumn("stride", F.explode(F.sequence(F.lit(1), F.lit(20)))).filter(F.ceil(F.col("t_len") / F.col("stride")) == F.col("n"))
    pairs = cand.join(tr, "demo_id").withColumn("t", F.col("i") * F.col("stride")).join(src.select("demo_id", "t", "a"), ["demo_id", "t"])
    close = pairs.groupBy("demo_id", "stride").agg(F.bool_and(F.abs(F.col("a") - F.col("b")) <= 1e-5 + 1e-5 * F.abs("b")).alias("close"))
    best = close.groupBy("demo_id").agg(F.min(F.when(F.col("close"), F.col("stride"))).alias("m"), F.min("stride").alias("i"))
    same = F.col("n") == F.col("t_len")
    method = (F.when(same, "same_length").when(F.col("m").isNotNull(), F.concat(F.lit("matched_actions_stride_"), "m"))
              .when(F.col("i").isNotNull(), F.concat(F.lit("inferred_stride_"), "i")).otherwise("linspace_fallback"))
    n = n.join(best, "demo_id", "left").select("demo_id", "n", "t_len", method.alias("method"), F.when(same, 1).otherwise(F.coalesce("m", "i")).alias("stride"))
    return n, tr, src


@query("j19_aligned_rows", """
with track as (select demo_id, 1 + demo_id % 4 as st from fx_demo),
 tl as (select d.demo_id, case when demo_id % 11 = 0 then t_len - 3 else (t_len + st - 1) // st end as n, st, t_len from fx_demo d join track using (demo_id)),
 r as (select *, unnest(range(n)) as i from tl),
 x as (select demo_id, i, case when n = t_len then i when demo_id % 11 <> 0 then i * st when n = 1 then 0 else round_even(i * ((t_len - 1) / (n - 1)), 0) end::bigint as t,
   case when n = t_len then 'same_length' when demo_id % 11 <> 0 then case when demo_id % 5 = 0 then 'inferred_stride_' || st else 'matched_actions_stride_' || st end else 'linspace_fallback' end as method from r)
select x.demo_id, x.i::bigint as i, x.t, s.value, x.method from x join fx_steps s on s.demo_id = x.demo_id and s.t = x.t""")
def aligned_rows(d: Data):
    """Every frame of the track with the source frame it is aligned with and that frame's value."""
    n, tr, src = strided(d)
    at = tr.select("demo_id", F.col("i").cast("bigint").alias("i")).join(n, "demo_id")
    even = F.when(F.col("n") > 1, F.rint(F.col("i") * ((F.col("t_len") - 1) / F.greatest(F.col("n") - 1, F.lit(1))))).otherwise(0.0)
    at = at.withColumn("t", F.coalesce(F.col("i") * F.col("stride"), even.cast("bigint")))
    rows = src.select("demo_id", F.col("t").cast("bigint").alias("t"), F.col("a").alias("value"))
    return at.join(rows, ["demo_id", "t"]).select("demo_id", "i", "t", "value", "method")


@query("j21_paired_frames", "select demo_id, t from fx_steps where event_type <> 'error' and event_id % 4 <> 0")
def paired_frames(d: Data):
    s = d.steps()
    return s.filter("event_type <> 'error'").select("demo_id", "t").intersect(s.filter("event_id % 4 <> 0").select("demo_id", "t"))


@query("u01_union_dedup", "select o_custkey as id from orders union select c_custkey from customer")
def union_dedup(d: Data):
    return d.table("orders").select(F.col("o_custkey").alias("id")).unionByName(d.table("customer").select(F.col("c_custkey").alias("id"))).distinct()


@query("u02_missing_indices", "select demo_id, t from fx_steps where event_type = 'error'")
def missing_indices(d: Data):
    there = d.steps().filter("event_type <> 'error'").select("demo_id", "t")
    full = d.demo().select("demo_id", F.explode(F.sequence(F.lit(0), F.col("t_len") - 1)).alias("t"))
    return full.join(there, ["demo_id", "t"], "left_anti")


@query("u03_required_minus_present", f"select demo_id, key_name from ({MISSING}) where why like 'missing:%'")
def required_minus_present(d: Data):
    want = d.demo().select("demo_id", F.explode(F.array(*[F.lit(k) for k in REQ])).alias("key_name"))
    return want.exceptAll(d.catalog().select("demo_id", "key_name"))


@query("u04_union_columns", "select demo_id, t_len, -1 as n_bad from fx_demo union all select demo_id, -1, count(why)::int from (" + MISSING + ") group by 1")
def union_columns(d: Data):
    a = d.demo().select("demo_id", "t_len")
    b = missing(d).groupBy("demo_id").agg(F.count("why").cast("int").alias("n_bad"))
    return a.unionByName(b, allowMissingColumns=True).fillna(-1, ["t_len", "n_bad"])
