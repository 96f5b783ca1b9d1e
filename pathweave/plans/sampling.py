"""Query selection, mask sampling and noise augmentation. All choices are hashes of ids."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.functions.numeric import clip, hash_unit, r6, text
from pathweave.operators import filters as flt
from pathweave.operators import sampling as smp
from pathweave.operators.sequence import meet, prefix
from pathweave.plans.fixtures import SIDE, Data, by_size
from pathweave.plans.geometry import UVM, mixed_uv
from pathweave.plans.registry import h32, q6, query
from pathweave.session import materialize


def unit_sql(*parts: str) -> str:
    return f"({h32(*parts)} / 4294967296.0)"


def queries_of(d: Data):
    """Query points of each demo: tracks that begin in the image, scaled to the tracker size when the values fit it."""
    a = mixed_uv(d).filter("t = 0").filter((F.col("point_id") + F.col("demo_id")) % 6 != 0)
    m = a.groupBy("demo_id").agg((F.max(F.greatest("u", "v")) <= SIDE + 1.5).alias("fits"))
    s = F.when(F.col("fits"), 518.0 / SIDE).otherwise(1.0)
    q = a.join(m, "demo_id").select("demo_id", "point_id", (F.col("u") * s).alias("u"), (F.col("v") * s).alias("v"))
    return q


def resize_to(q, keys, ids, n: int):
    """Exactly n rows per key: a hash sample when there are more, hash-chosen repeats when there are fewer."""
    few = smp.subsample(q, keys, ids, n, "resize")
    packed = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*ids, "u", "v"))).alias("p"))  # at most n entries
    r = packed.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    from pathweave.functions.numeric import hash_u32
    size = F.size("p")
    pick = F.when(F.col("r") < size, F.col("r")).otherwise(F.pmod(hash_u32(*keys, text("fill"), F.col("r"), 0), size).cast("int"))
    return r.select(*keys, "r", F.get("p", pick).alias("p")).select(*keys, "r", "p.*")


QUERIES = f"""qa as (select * from ({UVM}) where t = 0 and (point_id + demo_id) % 6 <> 0), qm as (select demo_id, max(greatest(u, v)) <= 17.5 as fits from qa group by 1),
 q as (select demo_id, point_id, u * case when fits then 518.0 / 16 else 1.0 end as u, v * case when fits then 518.0 / 16 else 1.0 end as v from qa join qm using (demo_id))"""


@query("w28_select_queries", " union all ".join(f"""
select * from (with {QUERIES}, k as (select *, row_number() over (partition by demo_id order by {h32('demo_id', 'point_id', "'resize'", '0')}, point_id) as hr from q),
 f as (select *, row_number() over (partition by demo_id order by point_id) - 1 as i, count(*) over (partition by demo_id) as m from k where hr <= {n})
select {n} as n, d.demo_id, d.r::int as r, point_id, {q6('least(greatest(u, 0), 517)')} as u, {q6('least(greatest(v, 0), 517)')} as v
from (select demo_id, unnest(range({n})) as r from fx_demo) d join f on f.demo_id = d.demo_id and f.i = case when d.r < f.m then d.r else {h32('d.demo_id', "'fill'", 'd.r', '0')} % f.m end)""" for n in (16, 30)))
def select_queries(d: Data):
    out = None
    for n in (16, 30):
        q = resize_to(queries_of(d), ["demo_id"], ["point_id"], n).select(
            F.lit(n).alias("n"), "demo_id", "r", "point_id", r6(clip(F.col("u"), 0.0, 517.0)).alias("u"), r6(clip(F.col("v"), 0.0, 517.0)).alias("v"))
        out = q if out is None else out.unionByName(q)
    return out


@query("w29_sample_mask_points", f"""
with m as (select demo_id, t, y * 16 + x as i from fx_mask), k as (select *, row_number() over (partition by demo_id, t order by {h32('demo_id', 't', 'i', "'mask'", '0')}, i) - 1 as r, count(*) over (partition by demo_id, t) as n from m),
 need as (select demo_id, t, unnest(range(12)) as j from fx_steps),
 s as (select need.demo_id, need.t, j, i from need join k on k.demo_id = need.demo_id and k.t = need.t and k.r = case when k.n >= 12 then j else {h32('need.demo_id', 'need.t', "'mrep'", 'j', '0')} % k.n end)
select demo_id, t, j::int as j, {q6(f"least(greatest(i % 16 + ({unit_sql('demo_id', 't', 'j', chr(39) + 'jx' + chr(39), '0')} * 0.7 - 0.35), 0), 15)")} as x,
  {q6(f"least(greatest(i // 16 + ({unit_sql('demo_id', 't', 'j', chr(39) + 'jy' + chr(39), '0')} * 0.7 - 0.35), 0), 15)")} as y from s""")
def sample_mask_points(d: Data, count: int = 12):
    from pathweave.functions.arrays import let
    from pathweave.functions.numeric import hash_u32
    idx = F.filter(F.transform("m", lambda v, i: F.when(v, i)), lambda i: i.isNotNull())

    def ranked(a):
        keyed = F.transform(a, lambda i: F.struct(hash_u32("demo_id", "t", i, text("mask"), 0).alias("h"), i.alias("i")))
        return let(F.sort_array(keyed), lambda o: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.get(o, F.when(
            F.size(o) >= count, j).otherwise(F.pmod(hash_u32("demo_id", "t", text("mrep"), j, 0), F.size(o)).cast("int")))["i"]))

    f = d.mask_images().select("demo_id", "t", let(idx, ranked).alias("p")).select(
        "demo_id", "t", F.posexplode_outer("p").alias("j", "i"))  # posexplode would have Spark test p's size first, hashing all over again
    def jitter(tag):
        return hash_unit("demo_id", "t", "j", text(tag), 0) * 0.7 - 0.35
    return f.select("demo_id", "t", "j", r6(clip(F.col("i") % SIDE + jitter("jx"), 0.0, SIDE - 1.0)).alias("x"),
                    r6(clip(F.floor(F.col("i") / SIDE) + jitter("jy"), 0.0, SIDE - 1.0)).alias("y"))


def gauss(*parts, tag: str):
    """Standard normal number of an id (Box-Muller on two hash numbers)."""
    u1 = F.greatest(hash_unit(*parts, text(tag), 1), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.lit(3.141592653589793) * hash_unit(*parts, text(tag), 2))


@query("h27_noise_augmentation")
def noise_augmentation(d: Data):
    """Global shift per demo, bias per point, drift along a point's frames, jitter per row, outlier tracks, dropped tracks that
    copy a kept one, clipping, and a permutation of the points (``slot``). Every input row has one output row."""
    d = d.indexed() if isinstance(d, Data) else d
    # one row per track: whether it is dropped, its donor among the kept ones, its new place
    flags = d.tracks().filter("t = 0").select("demo_id", "point_id", (hash_unit("demo_id", "point_id", text("drop"), 0) >= 0.1).alias("kept"))
    flags = materialize(flags, "flags")
    place = smp.hash_ranked(flags, ["demo_id"], ["point_id"], "perm", out="slot").select("demo_id", F.col("point_id").alias("to"), "slot")
    # who sends to whom: a track is written out once per receiver
    picks = materialize(flt.copies(flags, flt.random_donor(flags, "kept"), place), "picks")

    def noisy(tracks, whole: bool):
        walk = tracks.withColumns({f"g{a}": gauss("demo_id", "point_id", "t", tag=f"drift{a}") * 2.0 for a in "xyz"})
        if whole:
            upto = W.partitionBy("demo_id", "to").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
            walk = walk.withColumns({f"w{a}": F.sum(f"g{a}").over(upto) for a in "xyz"})
        else:
            walk = prefix(walk, ["demo_id", "to"], "t", {f"w{a}": ("sum", f"g{a}") for a in "xyz"})
        out = hash_unit("demo_id", "point_id", text("outlier"), 0) < 0.02
        cols = []
        for a in "xyz":
            noise = gauss("demo_id", tag=f"shift{a}") * 50 + gauss("demo_id", "point_id", tag=f"bias{a}") * 20 + F.col(f"w{a}")
            noise = noise + gauss("demo_id", "t", "point_id", tag=f"jitter{a}") * 5 + F.when(out, gauss("demo_id", "point_id", tag=f"big{a}") * 5000).otherwise(0.0)
            cols.append(r6(clip(F.col(f"{a}u") + noise, -100000.0, 100000.0)).alias(a))
        return walk.select("demo_id", "t", F.col("to").alias("point_id"), "slot", *cols)

    if isinstance(d, Data):  # its frames meet the list before their points are written out
        return by_size(d, lambda part, whole: noisy(part.tracks(picks), whole))
    return noisy(meet(d.tracks(), picks.select("demo_id", F.inline("picks")), ["demo_id", "point_id"]), False)
