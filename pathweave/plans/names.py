"""Text, names, ids, paths and the decisions taken from them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.functions import text as tx
from pathweave.operators.sequence import dense_index, first_n
from pathweave.plans.fixtures import Data
from pathweave.plans.registry import query

INSTR = """select p_partkey, case p_partkey % 6 when 0 then 'KITCHEN_SCENE' || p_size || '_pick_up_the_' || replace(p_name, ' ', '_') || '_and_put_it_in_the_basket_demo_tracks'
 when 1 then 'Pick up the ' || p_name || ' from the table, then place it!' when 2 then 'turn on two ' || p_name || 's' when 3 then 'study scene' || p_size || ' put ' || p_name || ' closer to the ' || p_type || ' demo 12'
 when 4 then p_name || ' ' || repeat(p_type || ' ', 20) else '  ' end as instr from part"""


def instructions(d: Data):
    p = d.table("part")
    p.createOrReplaceTempView("__pw_part")
    return d.spark.sql(INSTR.replace("from part", "from __pw_part"))


def norm_sql(c: str) -> str:
    out = f"trim(replace(lower({c}), '_', ' '))"
    for pat, rep in tx.INSTRUCTION_STEPS:
        out = f"regexp_replace({out}, '{pat}', '{rep}'" + (", 'g')" if pat == r"\s+" else ")")
    return f"trim({out})"


@query("h15_normalize_instruction", f"select p_partkey, {norm_sql('instr')} as key from ({INSTR})")
def normalize(d: Data):
    return instructions(d).select("p_partkey", tx.normalize_instruction(F.col("instr")).alias("key"))


SLUG = "trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '_')"
SAFE = f"case when nk = '' then 'unknown_task' else {SLUG.format(c='nk')} end"


@query("h16_slugs", f"""
with n as (select p_partkey, instr, {norm_sql('instr')} as nk from ({INSTR})), s as (select *, {SAFE} as safe from n),
 doc as (select doc_id, {"regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}]+', '_', 'g')"} as u from documents)
select 'part' as kind, p_partkey as id, case when length(safe) <= 120 then safe else rtrim(substr(safe, 1, 111), '_') || '_' || substr(sha1(safe), 1, 8) end as dir,
  case when {SLUG.format(c='instr')} = '' then 'video' else {SLUG.format(c='instr')} end as slug, substr(trim(regexp_replace(instr, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 1, 180) as clean from s
union all select 'document', doc_id, '', trim(substr(case when trim(u, '_') = '' then 'task' else trim(u, '_') end, 1, 96), '_'), '' from doc""")
def slugs(d: Data):
    c = F.col("instr")
    p = instructions(d).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), tx.dirname(c).alias("dir"), tx.task_slug(c).alias("slug"), tx.sanitize(c).alias("clean"))
    doc = d.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit("").alias("dir"), tx.slugify(F.col("text")).alias("slug"), F.lit("").alias("clean"))
    return p.unionByName(doc)


@query("h17_object_phrase", f"""
with t as (select p_partkey, regexp_replace(regexp_replace(lower(trim(instr)), '[.!?]+$', ''), '\\s+', ' ', 'g') as t from ({INSTR})),
 v as (select p_partkey, trim(regexp_replace(t, '^\\s*(?:{'|'.join(tx.VERBS)})\\s+(.*)$', '\\1')) as t from t),
 b as (select p_partkey, trim(regexp_replace(t, '\\b(?:{'|'.join(tx.BOUNDARIES)})\\b.*$', ''), ' ,') as t from v)
select p_partkey, trim(regexp_replace(t, '^(?:{'|'.join(tx.ARTICLES)})\\s+', '')) as phrase from b""")
def object_phrase(d: Data):
    return instructions(d).select("p_partkey", tx.object_phrase(F.col("instr")).alias("phrase"))


@query("h18_truncate_words", r"""
with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as l from documents)
select doc_id, array_to_string(list_slice(l, 1, 16), ' ') as short, case when len(l) = 0 then 'a robot task.' else array_to_string(list_slice(l, 1, 4), ' ') || '.' end as prefix from w""")
def truncate_words(d: Data):
    c = F.col("text")
    head = tx.truncate_words(c, 4)
    return d.table("documents").select("doc_id", tx.truncate_words(c, 16).alias("short"), F.when(head == "", "a robot task.").otherwise(F.concat(head, F.lit("."))).alias("prefix"))


STEM = """select p_partkey, case p_partkey % 3 when 0 then 'run--task=' || p_name || '--success=' || (case when p_size > 20 then 'True' else 'False' end) || '--env_id' || p_size when 1 then 'episode task=' || p_name else p_name || ' ' || p_type end as stem from part"""


@query("h19_parse_name_fields", f"""
with s as ({STEM}), f as (select p_partkey, stem, coalesce(trim(nullif(regexp_extract(stem, 'task=(.+?)(?:--success=|$)', 1), '')), stem) as task_text,
  nullif(regexp_extract(stem, '--success=([^-\\s]+)', 1), '') as success, nullif(regexp_extract(stem, '--env_id([^-\\s]+)', 1), '') as env_id from s)
select p_partkey, task_text, {SLUG.format(c='task_text')} as task_slug, coalesce(success, '') as success, coalesce(env_id, '') as env_id,
 concat_ws('__', {SLUG.format(c='task_text')}, 'success_' || success, 'env_id_' || env_id) || '.hdf5' as out_name from f""")
def parse_name(d: Data):
    p = d.table("part")
    p.createOrReplaceTempView("__pw_part")
    s = d.spark.sql(STEM.replace("from part", "from __pw_part"))
    f = tx.name_fields(F.col("stem"))
    return s.select("p_partkey", f["task_text"].alias("task_text"), f["task_slug"].alias("task_slug"), F.coalesce(f["success"], F.lit("")).alias("success"),
                    F.coalesce(f["env_id"], F.lit("")).alias("env_id"), f["out_name"].alias("out_name"))


@query("h20_count_items", "select doc_id, len(list_filter(string_split(text, ','), lambda x: trim(x) <> ''))::int as n_items from documents")
def count_items(d: Data):
    return d.table("documents").select("doc_id", tx.count_items(F.col("text")).alias("n_items"))


@query("h21_task_description", """
select p_partkey, case p_type when 'ECONOMY' then 'Place the part on the shelf.' when 'STANDARD' then 'Push the part forward.' else 'Perform the task.' end as description from part""")
def task_description(d: Data):
    names = F.create_map(F.lit("ECONOMY"), F.lit("Place the part on the shelf."), F.lit("STANDARD"), F.lit("Push the part forward."))
    return d.table("part").select("p_partkey", F.coalesce(F.element_at(names, F.col("p_type")), F.lit("Perform the task.")).alias("description"))


@query("h22_mask_meta", """
with k as (select event_id, regexp_extract(props, '(\\d+)', 1)::int as k from events)
select event_id, case when k % 7 = 0 then '' when k % 3 = 1 then 'first' when k % 2 = 1 then 'second' else '' end as label,
  case when k % 7 = 0 then -1.0 when k % 3 = 1 then 0.5 when k % 2 = 1 then k::double else -1.0 end::double as logit from k""")
def mask_meta(d: Data):
    k = F.get_json_object("props", "$.k").cast("int")
    # a list of objects per row; every seventh is broken on purpose and must give nothing
    txt = F.when(k % 7 == 0, F.lit("[{oops")).otherwise(F.concat(
        F.lit('[{"value":'), (k % 3).cast("string"), F.lit(',"label":"first","logit":0.5},{"value":'), (k % 2).cast("string"), F.lit(',"label":"second","logit":'), k.cast("string"), F.lit("}]")))
    meta = F.from_json(txt, "array<struct<value:int,label:string,logit:double>>", {"mode": "PERMISSIVE"})
    hit = F.get(F.filter(meta, lambda x: x["value"] == 1), F.lit(0))
    return d.table("events").select("event_id", hit.alias("h")).select("event_id", F.coalesce("h.label", F.lit("")).alias("label"), F.coalesce("h.logit", F.lit(-1.0)).alias("logit"))


PATHS = """select page_id, url || case page_id % 5 when 0 then '/LIBERO_90/KITCHEN_SCENE3_open_demo_tracks.hdf5' when 1 then '/ManiSkill/PickCube-v1_tracks.hdf5' when 2 then '/real/task_b_tracks.hdf5' when 3 then '/x/study_scene1_demo.hdf5' else '' end as path from pages"""


@query("s03_path_columns", f"""
with p as ({PATHS}), f as (select page_id, path, case when regexp_matches(lower(path), 'maniskill|pickcube|pushcube|stackcube') then 'maniskill' when regexp_matches(lower(path), 'libero|kitchen_scene|living_room_scene|study_scene') then 'libero' else '' end as fam,
  string_split(path, '/') as parts from p)
select page_id, case when fam = '' then 'real' else fam end as family_train, case when fam = '' then 'libero' else fam end as family_predict, parts[len(parts) - 1] as suite,
 trim(replace(replace(regexp_replace(parts[len(parts)], '\\.[^.]*$', ''), '_demo', ''), '_', ' ')) as task_text from f""")
def path_columns(d: Data):
    p = d.table("pages")
    p.createOrReplaceTempView("__pw_pages")
    p = d.spark.sql(PATHS.replace("from pages", "from __pw_pages"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return p.select("page_id", tx.family(F.col("path")).alias("family_train"), tx.family(F.col("path"), "libero").alias("family_predict"),
                    F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("suite"),
                    F.trim(F.regexp_replace(F.regexp_replace(stem, "_demo", ""), "_", " ")).alias("task_text"))


@query("s08_list_frame_indices", """
with l as (select event_id, case event_type when 'click' then 'main_' || event_id || '.png' when 'view' then 'wrist_' || event_id || '.png' when 'error' then 'main_' || event_id || '.jpg' else 'wrist_x' || event_id || '.png' end as name from events)
select regexp_extract(name, '^(main|wrist)_(\\d+)\\.png$', 1) as kind, regexp_extract(name, '^(main|wrist)_(\\d+)\\.png$', 2)::bigint as idx from l where regexp_matches(name, '^(main|wrist)_(\\d+)\\.png$')""")
def frame_indices(d: Data):
    e = F.col("event_id").cast("string")
    name = (F.when(F.col("event_type") == "click", F.concat(F.lit("main_"), e, F.lit(".png"))).when(F.col("event_type") == "view", F.concat(F.lit("wrist_"), e, F.lit(".png")))
            .when(F.col("event_type") == "error", F.concat(F.lit("main_"), e, F.lit(".jpg"))).otherwise(F.concat(F.lit("wrist_x"), e, F.lit(".png"))))
    pat = r"^(main|wrist)_(\d+)\.png$"
    l = d.table("events").select(name.alias("name")).filter(F.col("name").rlike(pat))
    return l.select(F.regexp_extract("name", pat, 1).alias("kind"), F.regexp_extract("name", pat, 2).cast("bigint").alias("idx"))


IDS = "case when s_suppkey % 7 = 3 then s_name when s_suppkey % 7 = 5 then 'demo_x' || s_suppkey else 'demo_' || (s_suppkey * 37 % 101) end"


@query("p01_natural_order", f"""
with i as (select s_suppkey, s_nationkey, {IDS} as demo from supplier),
 k as (select *, regexp_matches(demo, '_\\d+$') as dig, case when regexp_matches(demo, '_\\d+$') then regexp_extract(demo, '_(\\d+)$', 1)::bigint end as n from i)
select s_nationkey, s_suppkey, demo, row_number() over (partition by s_nationkey order by case when dig then 0 else 1 end, n, demo, s_suppkey)::int as pos from k""")
def natural_order(d: Data):
    s = d.table("supplier").select("s_suppkey", "s_nationkey", F.expr(IDS).alias("demo"))
    tail, number, _ = tx.natural_key(F.col("demo"))
    s = s.withColumns({"tail": tail, "number": F.coalesce(number, F.lit(-1))})
    # a file may hold any number of demos: positions come from counts per number range, not from one big window
    pos = dense_index(s, ["s_nationkey"], ["demo", "s_suppkey"], [F.col("tail"), F.floor(F.col("number") / 64), F.col("number")], "pos")
    return pos.select("s_nationkey", "s_suppkey", "demo", (F.col("pos") + 1).alias("pos"))


@query("p02_select_demos", f"""
with i as (select s_suppkey, s_nationkey, {IDS} as demo from supplier where s_nationkey not in (3, 4)),
 k as (select *, regexp_matches(demo, '_\\d+$') as dig, case when regexp_matches(demo, '_\\d+$') then regexp_extract(demo, '_(\\d+)$', 1)::bigint end as n from i)
select s_nationkey, s_suppkey from (select *, row_number() over (partition by s_nationkey order by case when dig then 0 else 1 end, n, demo, s_suppkey) as r from k) where r <= 2""")
def select_demos(d: Data, n: int = 2):
    s = d.table("supplier").select("s_suppkey", "s_nationkey", F.expr(IDS).alias("demo")).filter(~F.col("s_nationkey").isin(3, 4))
    return first_n(s, ["s_nationkey"], [*tx.natural_key(F.col("demo")), F.col("s_suppkey")], n, salt_by=["s_suppkey"]).select("s_nationkey", "s_suppkey")


@query("t05_pick_one", f"""
with i as (select s_suppkey, s_nationkey, {IDS} as demo from supplier),
 k as (select *, regexp_matches(demo, '_\\d+$') as dig, case when regexp_matches(demo, '_\\d+$') then regexp_extract(demo, '_(\\d+)$', 1)::bigint end as n from i)
select s_nationkey, demo from (select *, row_number() over (partition by s_nationkey order by case when dig then 0 else 1 end, n, demo) as r from k) where r = 1""")
def pick_one(d: Data):
    s = d.table("supplier").select("s_nationkey", F.expr(IDS).alias("demo"))
    key = tx.natural_key(F.col("demo"))
    return s.groupBy("s_nationkey").agg(F.min_by("demo", F.struct(key[0], F.coalesce(key[1], F.lit(0)), key[2])).alias("demo"))


@query("t08_pick_random_demo", """
select task, arg_min(demo_id, h) as demo_id from (select task, demo_id, md5(concat_ws('|', demo_id, 'pick', 0)) as h from fx_demo) group by task""")
def pick_random(d: Data):
    return d.demo().groupBy("task").agg(F.min_by("demo_id", F.md5(F.concat_ws("|", "demo_id", F.lit("pick"), F.lit(0)))).alias("demo_id"))


@query("p12_drop_indices", """
with dr as (select demo_id, list_transform(list_filter(string_split(replace(concat(demo_id % 24, ',', (demo_id * 5) % 24, ';', (demo_id * 7 + 1) % 24, ';'), ';', ','), ','), lambda x: trim(x) <> ''), lambda x: x::int) as l from fx_demo)
select demo_id, t, point_id from fx_tracks join dr using (demo_id) where not list_contains(l, point_id::int)""")
def drop_indices(d: Data):
    spec = F.concat((F.col("demo_id") % 24).cast("string"), F.lit(","), (F.col("demo_id") * 5 % 24).cast("string"), F.lit(";"), ((F.col("demo_id") * 7 + 1) % 24).cast("string"), F.lit(";"))
    gone = d.demo().select("demo_id", F.explode(tx.parse_indices(spec).cast("array<bigint>")).alias("point_id"))
    return d.tracks().join(gone, ["demo_id", "point_id"], "left_anti").select("demo_id", "t", "point_id")


@query("p13_parse_task_ids", """
with s as (select n_nationkey, case when n_nationkey % 4 = 0 then '' else concat(n_nationkey % 10, ', ', (n_nationkey + 3) % 10) end as spec from nation)
select n_nationkey, unnest(case when trim(spec) = '' then range(10) else list_transform(string_split(spec, ','), lambda x: trim(x)::bigint) end)::int as task_id from s""")
def parse_task_ids(d: Data, n_tasks: int = 10):
    spec = F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.concat((F.col("n_nationkey") % 10).cast("string"), F.lit(", "), ((F.col("n_nationkey") + 3) % 10).cast("string")))
    ids = F.when(F.trim(spec) == "", F.sequence(F.lit(0), F.lit(n_tasks - 1))).otherwise(tx.parse_indices(spec))
    checked = F.transform(ids, lambda i: F.when((i >= 0) & (i < n_tasks), i).otherwise(F.raise_error(F.lit("task id out of range")).cast("int")))
    return d.table("nation").select("n_nationkey", F.explode(checked).alias("task_id"))


@query("p06_only_suites", "select demo_id, suite from fx_demo where suite in ('suite_1', 'suite_3')")
def only_suites(d: Data):
    return d.demo().filter(F.col("suite").isin("suite_1", "suite_3")).select("demo_id", "suite")


@query("p07_episode_range", """
with e as (select event_id, case when event_id % 9 = 4 then 'ep' || event_id else (event_id % 173)::varchar end as episode from events)
select event_id, episode from e where try_cast(episode as int) between 51 and 100""")
def episode_range(d: Data):
    e = d.table("events").select("event_id", F.when(F.col("event_id") % 9 == 4, F.concat(F.lit("ep"), F.col("event_id"))).otherwise((F.col("event_id") % 173).cast("string")).alias("episode"))
    return e.filter(F.col("episode").try_cast("int").between(51, 100))


@query("p24_episode_layout", """
select demo_id, case when bool_or(key_name = 'frames_rgb') and bool_or(key_name = 'actions') then 'single' when bool_or(key_name = 'track2d') then 'multi' else 'unknown' end as layout from fx_catalog group by demo_id""")
def episode_layout(d: Data):
    def has(k):
        return F.bool_or(F.col("key_name") == k)
    return d.catalog().groupBy("demo_id").agg(F.when(has("frames_rgb") & has("actions"), "single").when(has("track2d"), "multi").otherwise("unknown").alias("layout"))


SHAPES = """select p_partkey, case p_partkey % 4 when 0 then [10, 3, 100 + p_size, 200] when 1 then [10, 90 + p_size, 160, 3] when 2 then [10, 5] else null end as shape from part"""


@query("p23_frame_hw", f"""
with s as ({SHAPES}) select p_partkey, (case when len(shape) = 4 and shape[4] in (1, 3, 4) then shape[2] when len(shape) = 4 and shape[2] in (1, 3, 4) then shape[3] else 128 end)::int as h,
 (case when len(shape) = 4 and shape[4] in (1, 3, 4) then shape[3] when len(shape) = 4 and shape[2] in (1, 3, 4) then shape[4] else 128 end)::int as w from s""")
def frame_hw(d: Data):
    ints = [F.lit(v) for v in (10, 3, 200, 160, 5)]
    k = F.col("p_partkey") % 4
    shape = F.when(k == 0, F.array(ints[0], ints[1], 100 + F.col("p_size"), ints[2])).when(k == 1, F.array(ints[0], 90 + F.col("p_size"), ints[3], ints[1])).when(k == 2, F.array(ints[0], ints[4]))
    s = d.table("part").select("p_partkey", shape.alias("s"))
    four = F.size("s") == 4
    last, first = four & F.get("s", F.lit(3)).isin(1, 3, 4), four & F.get("s", F.lit(1)).isin(1, 3, 4)
    def pick(a, b):
        return F.when(last, F.get("s", F.lit(a))).when(first, F.get("s", F.lit(b))).otherwise(128)
    return s.select("p_partkey", pick(1, 2).alias("h"), pick(2, 3).alias("w"))


GATE = """select o_orderkey, o_custkey % 5 as n_steps, case when o_orderkey % 7 = 0 then ' ' else o_orderpriority end as instr, o_orderkey % 11 = 0 as no_image, o_orderkey % 13 = 0 as no_action, o_orderstatus = 'P' as exists_already, o_orderkey % 17 as n_query from orders"""
REASON = """case when n_steps < 2 then 'too_short' when trim(instr) = '' then 'missing_instruction' when no_image then 'missing_image_key' when no_action then 'missing_action' when n_query < 3 then 'too_few_queries' when exists_already then 'existing' else 'saved' end"""


def gated(d: Data):
    o = d.table("orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("n_steps"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("instr"),
                                 (F.col("o_orderkey") % 11 == 0).alias("no_image"), (F.col("o_orderkey") % 13 == 0).alias("no_action"), (F.col("o_orderstatus") == "P").alias("exists"), (F.col("o_orderkey") % 17).alias("n_query"))
    checks = ((F.col("n_steps") < 2, "too_short"), (F.trim("instr") == "", "missing_instruction"), (F.col("no_image"), "missing_image_key"), (F.col("no_action"), "missing_action"),
              (F.col("n_query") < 3, "too_few_queries"), (F.col("exists"), "existing"))
    reason = F.lit("saved")
    for cond, name in reversed(checks):  # the first failing check names the reason
        reason = F.when(cond, name).otherwise(reason)
    return o.withColumn("reason", reason)


@query("p17_episode_gates", f"select o_orderkey, {REASON} as reason from ({GATE})")
def episode_gates(d: Data):
    return gated(d).select("o_orderkey", "reason")


@query("a13_episode_funnel", f"""
with g as (select {REASON} as reason, greatest(n_steps - 1, 0) as tr from ({GATE}))
select coalesce(reason, 'total') as reason, count(*)::bigint as episodes, sum(tr)::bigint as transitions from g group by rollup(reason)""")
def episode_funnel(d: Data):
    g = gated(d).rollup("reason").agg(F.count(F.lit(1)).alias("episodes"), F.sum(F.greatest(F.col("n_steps") - 1, F.lit(0))).alias("transitions"))
    return g.withColumn("reason", F.coalesce("reason", F.lit("total")))


PARAM = """select l_orderkey * 8 + l_linenumber as pid, case l_partkey % 7 when 0 then 'encoder.siglip_model.vision_model.l' when 1 then 'encoder.siglip_model.text_model.l' when 2 then 'feat_3d_head.q' when 3 then 'dit.block'
 when 4 then 'encoder.img_proj' when 5 then 'encoder.mem_proj' else 'encoder.dinov2_model.b' end || '.' || l_suppkey || '.' || l_orderkey || '.' || l_linenumber || '.' || l_shipdate::varchar as name, l_quantity::bigint as numel, l_returnflag as dtype, l_linestatus = 'O' as trainable from lineitem"""


@query("a44_group_share", f"""
with p as (select *, case when name like 'encoder.siglip_model.vision_model%' or name like 'encoder.dinov2_model%' or name like 'encoder.img_proj%' then 'vision_encoder' when name like 'encoder.siglip_model.text_model%' then 'text_encoder'
   when name like 'feat_3d_head%' then 'perceiver_3d' when name like 'dit%' then 'flow_dit' else 'others' end as grp from ({PARAM.replace("l_shipdate::varchar", "strftime(l_shipdate, '%Y%m%d')")})),
 g as (select grp, sum(numel)::bigint as total, sum(numel) filter (trainable)::bigint as trainable, count(*) filter (dtype = 'R')::bigint as n_r, count(*) filter (dtype = 'N')::bigint as n_n from p group by 1),
 k as (select grp, string_agg(numel::varchar, ',' order by r) as top from (select grp, numel, row_number() over (partition by grp order by numel desc, name) as r from p) where r <= 5 group by 1)
select grp, total, trainable, n_r, n_n, round_even(100.0 * total / (sum(total) over ()) * 1e6, 0) / 1e6 as share, top from g join k using (grp)""")
def group_share(d: Data):
    k = F.col("l_partkey") % 7
    heads = ["encoder.siglip_model.vision_model.l", "encoder.siglip_model.text_model.l", "feat_3d_head.q", "dit.block", "encoder.img_proj", "encoder.mem_proj"]
    head = F.lit("encoder.dinov2_model.b")
    for i in range(5, -1, -1):
        head = F.when(k == i, heads[i]).otherwise(head)
    p = d.table("lineitem").select(F.concat_ws(".", head, "l_suppkey", "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd")).alias("name"), F.col("l_quantity").cast("bigint").alias("numel"),
                                   F.col("l_returnflag").alias("dtype"), (F.col("l_linestatus") == "O").alias("trainable"))
    p = p.withColumn("grp", tx.param_group(F.col("name")))
    g = p.groupBy("grp").agg(F.sum("numel").alias("total"), F.sum(F.when(F.col("trainable"), F.col("numel"))).alias("trainable"), F.count_if(F.col("dtype") == "R").alias("n_r"), F.count_if(F.col("dtype") == "N").alias("n_n"))
    top = first_n(p, ["grp"], [F.col("numel").desc(), F.col("name")], 5, salt_by=["name"])
    top = top.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "numel"))), lambda s: s["numel"].cast("string")), ",").alias("top"))
    share = F.rint(100.0 * F.col("total") / F.sum("total").over(W.partitionBy(F.lit(0))) * 1e6) / 1e6  # five groups
    return g.withColumn("share", share).join(top, "grp").select("grp", "total", "trainable", "n_r", "n_n", "share", "top")


@query("a49_infer_dims", """
with r as (select user_id as ds, event_id, case when event_id % 6 = 0 then 0 when event_id % 29 = 1 then 6 else 7 end as n_joints from events),
 f as (select ds, arg_min(n_joints + 1, event_id) as dim from r where n_joints > 0 group by 1)
select ds, any_value(dim)::int as dim, count(*) filter (n_joints + 1 = dim)::bigint as kept, count(*) filter (n_joints > 0 and n_joints + 1 <> dim)::bigint as dropped from r join f using (ds) group by ds""")
def infer_dims(d: Data):
    n = F.when(F.col("event_id") % 6 == 0, 0).when(F.col("event_id") % 29 == 1, 6).otherwise(7)
    r = d.table("events").select(F.col("user_id").alias("ds"), "event_id", F.array_repeat(F.lit(0.0), n).alias("joints"))
    dim = r.filter(F.size("joints") > 0).groupBy("ds").agg(F.min_by(F.size("joints") + 1, "event_id").alias("dim"))
    width = F.size("joints") + 1
    return r.join(dim, "ds").groupBy("ds").agg(F.max("dim").alias("dim"), F.count_if(width == F.col("dim")).alias("kept"), F.count_if((F.size("joints") > 0) & (width != F.col("dim"))).alias("dropped"))




@query("j05_lookup_prompt", """
with pr as (select case n_nationkey % 5 when 0 then 'base_name' when 1 then 'hdf5_stem' when 2 then 'path' when 3 then 'task_text' else 'text' end as space, lower(trim(n_name)) as key, 'prompt ' || n_nationkey as prompt from nation),
 c as (select s_suppkey, 'NATION_' || (s_suppkey % 40) as k0, 'nation_' || ((s_suppkey * 3) % 40) as k1, ' Nation_' || ((s_suppkey * 7) % 40) || ' ' as k2, s_name as txt from supplier),
 e as (select s_suppkey, txt, 1 as prio, 'base_name' as space, lower(trim(k0)) as key from c union all select s_suppkey, txt, 2, 'hdf5_stem', lower(trim(k1)) from c union all select s_suppkey, txt, 3, 'path', lower(trim(k1)) from c
   union all select s_suppkey, txt, 4, 'task_text', lower(trim(k2)) from c union all select s_suppkey, txt, 5, 'text', lower(trim(k2)) from c)
select s_suppkey, 'robot: ' || coalesce(arg_min(prompt, prio) filter (prompt is not null), nullif(any_value(txt), ''), 'do the task') as prompt from e left join pr using (space, key) group by s_suppkey""")
def lookup_prompt(d: Data):
    spaces = ("base_name", "hdf5_stem", "path", "task_text", "text")
    k = F.col("n_nationkey") % 5
    sp = F.element_at(F.array(*[F.lit(s) for s in spaces]), k + 1)
    prompts = d.table("nation").select(sp.alias("space"), F.lower(F.trim("n_name")).alias("key"), F.concat(F.lit("prompt "), F.col("n_nationkey")).alias("prompt"))
    s = F.col("s_suppkey")
    k0, k1, k2 = F.concat(F.lit("NATION_"), s % 40), F.concat(F.lit("nation_"), s * 3 % 40), F.concat(F.lit(" Nation_"), s * 7 % 40, F.lit(" "))
    cand = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(n).alias("space"), F.lower(F.trim(c)).alias("key")) for i, (n, c) in enumerate(zip(spaces, (k0, k1, k1, k2, k2)))])
    e = d.table("supplier").select("s_suppkey", F.col("s_name").alias("txt"), F.inline(cand)).join(prompts, ["space", "key"], "left")
    first = F.min_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("prio")))
    return e.groupBy("s_suppkey").agg(F.concat(F.lit("robot: "), F.coalesce(first, F.nullif(F.max("txt"), F.lit("")), F.lit("do the task"))).alias("prompt"))


@query("j05_resolve_prompt", r"""
with r as (select p_partkey, case when p_partkey % 4 = 0 then ' prompt ' || p_size || ' ' when p_partkey % 4 = 1 then '  ' end as found,
   case p_partkey % 3 when 0 then p_name || '/' || p_type || ' ' || p_brand || ' by the door' when 1 then '' end as task from part)
select p_partkey, 'robot. ' || coalesce(nullif(trim(found), ''), case when task <> '' then array_to_string(list_slice(list_filter(regexp_split_to_array(replace(task, '/', ' '), '\s+'), lambda x: x <> ''), 1, 4), ' ') end, 'object') as prompt,
  'a:. ' || coalesce(nullif(trim(found), ''), 'the ring') as fixed from r""")
def resolve_prompt(d: Data):
    k = F.col("p_partkey")
    found = F.when(k % 4 == 0, F.concat(F.lit(" prompt "), F.col("p_size"), F.lit(" "))).when(k % 4 == 1, "  ")
    task = F.when(k % 3 == 0, F.concat("p_name", F.lit("/"), "p_type", F.lit(" "), "p_brand", F.lit(" by the door"))).when(k % 3 == 1, "")
    return d.table("part").select("p_partkey", tx.resolve_prompt(found, None, task, 4, "robot").alias("prompt"),
                                  tx.resolve_prompt(found, " the ring ", task, 4, "a:.").alias("fixed"))


@query("j26_mask_dir_candidates", """
with c as (select s_suppkey, unnest([0, 1, 2, 3]) as prio, unnest(['stem_' || s_name, 'stem_' || s_suppkey, 'stem_demo_' || s_name, s_name]) as dir from supplier),
 l as (select case s_suppkey % 4 when 0 then 'stem_' || s_name when 1 then 'stem_' || s_suppkey when 2 then s_name else 'other_' || s_name end as dir from supplier)
select s_suppkey, arg_min(dir, prio) as dir from c where dir in (select dir from l) group by s_suppkey""")
def mask_dirs(d: Data):
    s = d.table("supplier")
    key = F.col("s_suppkey").cast("string")
    cands = F.array(F.concat(F.lit("stem_"), "s_name"), F.concat(F.lit("stem_"), key), F.concat(F.lit("stem_demo_"), "s_name"), F.col("s_name"))
    k = F.col("s_suppkey") % 4
    listing = s.select(F.when(k == 0, F.concat(F.lit("stem_"), "s_name")).when(k == 1, F.concat(F.lit("stem_"), key)).when(k == 2, F.col("s_name")).otherwise(F.concat(F.lit("other_"), "s_name")).alias("dir"))
    c = s.select("s_suppkey", F.posexplode(cands).alias("prio", "dir")).join(listing.distinct(), "dir")
    return c.groupBy("s_suppkey").agg(F.min_by("dir", "prio").alias("dir"))
