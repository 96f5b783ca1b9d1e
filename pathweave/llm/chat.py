"""Chat formatting by rotating perspectives: every participant in turn is the assistant.

For each participant of a conversation the dialogue is rendered with that speaker as assistant and the others as users with
names; the mask marks what the assistant wrote (its text and end mark), the part a model would learn. System turns belong to nobody and are
rendered as such for everyone.

A conversation is rendered in parts of PART turns by their numbers, so the longest one is spread over many tasks; the parts in
order, one after another, are the whole. Spans count code points within the part.

Defined results: turns are ordered by (turn, role, text), null turns last in a part of their own, repeated rows stay; null text is
empty, a null role is named ``unknown``; rows without conv_id are one conversation; '<|' within texts and names becomes '< |', so that no text can forge
a mark; a conversation of system turns only has no participant and gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 256
SYSTEM = ("system",)
END = "<|end|>"


def rotate(turns: DataFrame, part: int = PART, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """One row per (conv_id, speaker, part): n_turns, rendered, mask ("start:end" joined by commas), n_masked."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    own = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), safe(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))).alias("role"),
        safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    number = F.coalesce(F.floor(F.col("turn") / part), F.lit((1 << 63) - 1)).alias("part")
    order = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "role", "text")
    parts = own.groupBy("conv_id", number).agg(F.sort_array(F.collect_list(order)).alias("turns"))
    speakers = own.filter(~F.col("role").isin(*system)).select(F.col("conv_id").alias("conv"), F.col("role").alias("speaker")).distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")

    def head(role):
        return F.when(role == F.col("speaker"), F.lit("<|assistant|>\n")).when(role.isin(*system), F.lit("<|system|>\n")).otherwise(
            F.concat(F.lit("<|user name="), role, F.lit("|>\n")))

    pieces = F.transform("turns", lambda t: F.struct(head(t.role).alias("head"), F.concat(t.text, F.lit(END)).alias("body"), (t.role == F.col("speaker")).alias("mine")))
    both = both.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc, p):
        a = acc.at + F.length(p.head)
        b = a + F.length(p.body)
        return F.struct((b + 1).alias("at"), F.when(p.mine, F.concat(acc.spans, F.array(F.struct(a.alias("a"), b.alias("b"))))).otherwise(acc.spans).alias("spans"))

    both = both.withColumn("spans", F.aggregate("pieces", start, step)["spans"])
    return both.select(
        "conv_id", "speaker", "part", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.a, s.b)), ",").alias("mask"),
        F.aggregate("spans", F.lit(0), lambda n, s: n + s.b - s.a).alias("n_masked"))


def sql(part: int = PART) -> str:
    """The same for DuckDB."""
    top = (1 << 63) - 1
    return f"""
    with t as (select conv_id, coalesce(turn, {top}) as turn, replace(coalesce(role, 'unknown'), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text,
                      case when turn is null then {top} else turn // {part} end as part from conversations),
    s as (select distinct conv_id, role as speaker from t where role <> 'system'),
    p as (select t.conv_id, speaker, part, turn, role, text, role = speaker as mine,
                 case when role = speaker then '<|assistant|>' || chr(10) when role = 'system' then '<|system|>' || chr(10) else '<|user name=' || role || '|>' || chr(10) end as head,
                 text || '{END}' as body from t join s on t.conv_id is not distinct from s.conv_id),
    o as (select *, sum(length(head) + length(body) + 1) over (partition by conv_id, speaker, part order by turn, role, text rows unbounded preceding) as stop,
                 row_number() over (partition by conv_id, speaker, part order by turn, role, text) as i from p)
    select conv_id, speaker, part, count(*)::int as n_turns, string_agg(head || body || chr(10), '' order by i) as rendered,
           coalesce(string_agg((stop - 1 - length(body)) || ':' || (stop - 1), ',' order by i) filter (where mine), '') as mask,
           coalesce(sum(length(body)) filter (where mine), 0)::int as n_masked
    from o group by conv_id, speaker, part"""
