"""URL filter: fixed rules, and empirical-Bayes reputation of hosts where no rule speaks.

Pages that a rule decides are labelled outcomes (block 1, allow 0). A host's rate of blocked pages is shrunk towards its registered
domain's, that towards its suffix's, that towards the rate of all, each through a beta prior whose strength is estimated
from how much the children of one parent differ beyond binomial noise. A page without rule is blocked where the lower bound of its
host's posterior reaches ``threshold``. Only counts per host meet; pages join the hosts afterwards, and Spark splits hot hosts.

Defined results: a null url or one without '://' has an empty host and path and no rule; the empty host is a host like others; repeated
rows get equal answers; without labelled pages the rate of all is 0, so nothing is blocked by reputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Public suffixes of two labels that are told apart from registered domains.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.mx", "co.in", "co.za", "com.cn")
THRESHOLD, Z = 0.5, 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; ports don't count, and an address of numbers is a domain of its own."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    suffix = F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(two.isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)
    number = F.regexp_like(name, F.lit(r"^[0-9.]+$"))
    return F.when(number, name).otherwise(domain), F.when(number, F.lit("")).otherwise(suffix)


def strength(children: DataFrame, parent: str) -> float:
    """Prior strength from the spread of the children's rates within their parents (moments of the beta-binomial)."""
    m = F.col("k_") / F.col("n_")
    spread = (children.filter("n > 0").groupBy(parent).agg(
        F.sum("n").alias("n_"), F.sum("k").alias("k_"), F.count(F.lit(1)).alias("c_"), F.sum(F.col("n") * F.col("n")).alias("nn_"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk_"))
        .select((F.col("kk_") - F.col("k_") * m - m * (1 - m) * (F.col("c_") - 1)).alias("top"),
                (m * (1 - m) * (F.col("n_") - F.col("nn_") / F.col("n_") - (F.col("c_") - 1))).alias("low")))
    top, low = spread.agg(F.sum("top"), F.sum("low")).first()
    share = top / low if top is not None and low and low > 0 else 0.5
    share = min(0.999, max(0.001, share))
    return 1 / share - 1


def reputations(pages: DataFrame, z: float = Z) -> DataFrame:
    """Per host: n labelled pages, k blocked, mean and lower bound of the posterior. ``pages`` has host and blocked (null: unlabelled)."""
    hosts = pages.groupBy("host").agg(F.count("blocked").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("k"))
    domain, suffix = levels(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("root", F.lit(""))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    mean = k / n if n else 0.0
    s_host, s_domain, s_suffix = strength(hosts, "domain"), strength(domains, "suffix"), strength(suffixes, "root")
    suffixes = suffixes.select("suffix", ((mean * s_suffix + F.col("k")) / (s_suffix + F.col("n"))).alias("of_suffix"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", "suffix", ((F.col("of_suffix") * s_domain + F.col("k")) / (s_domain + F.col("n"))).alias("of_domain"))
    total = s_host + F.col("n")
    mean_ = (F.col("of_domain") * s_host + F.col("k")) / total
    return hosts.join(domains, ["domain", "suffix"]).select(
        "host", "n", "k", mean_.alias("mean"), (mean_ - z * F.sqrt(mean_ * (1 - mean_) / (total + 1))).alias("lower"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict; and the bound ``lower`` of the host's posterior."""
    host, path = host_and_path(F.col("url").cast("string"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "verdict": verdict})
    known = reputations(own.select("host", F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "block").cast("int")).alias("blocked")), z)
    judged = F.when(F.col("lower") >= threshold, "block").otherwise("allow")
    return own.join(known.select("host", "lower"), "host").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), "lower")


def sql() -> str:
    """The same for DuckDB."""
    cases = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "case " + " ".join(f"when {c} then '{r}'" for c, r, _ in cases) + " end"
    verdict = "case " + " ".join(f"when {c} then '{v}'" for c, _, v in cases) + " end"
    two = "', '".join(SUFFIXES)

    def last(n):
        return f"array_to_string(string_split(name, '.')[-{n}:], '.')"

    def prior(table, parent):
        m = "(k_ / n_)"
        return f"""(select coalesce(1 / greatest(0.001, least(0.999, case when sum(low) > 0 then sum(top) / sum(low) else 0.5 end)) - 1, 1.0) from (
            select kk_ - k_ * {m} - {m} * (1 - {m}) * (c_ - 1) as top, {m} * (1 - {m}) * (n_ - nn_ / n_ - (c_ - 1)) as low from (
            select sum(n)::double n_, sum(k)::double k_, count(*)::double c_, sum(n * n)::double nn_, sum(k * k / n)::double kk_ from {table} where n > 0 group by {parent})))"""

    return f"""
    with p as (select page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) end as rest from pages),
    q as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p),
    r as (select *, {rule} as rule, {verdict} as v from q),
    h0 as (select host, regexp_replace(host, ':[0-9]*$', '') as name, count(v)::double as n, coalesce(sum((v = 'block')::int), 0)::double as k from r group by host),
    h1 as (select *, {last(2)} as two, regexp_matches(name, '^[0-9.]+$') as num from h0),
    h as (select host, n, k, case when num then name when two in ('{two}') then {last(3)} else two end as domain,
                 case when num then '' when two in ('{two}') then two else {last(1)} end as suffix from h1),
    d as (select domain, suffix, sum(n) as n, sum(k) as k from h group by all),
    s as (select suffix, sum(n) as n, sum(k) as k, '' as root from d group by suffix),
    c as (select (select case when sum(n) > 0 then sum(k) / sum(n) else 0 end from s) as m, {prior('h', 'domain')} as sh, {prior('d', 'suffix')} as sd, {prior('s', 'root')} as ss),
    sp as (select suffix, (m * ss + k) / (ss + n) as rate from s, c),
    dp as (select d.domain, d.suffix, (rate * sd + k) / (sd + n) as rate from d join sp using (suffix), c),
    hp as (select host, (rate * sh + k) / (sh + n) as m, sh + n as total from h join dp using (domain, suffix), c)
    select page_id, r.host, path, rule, coalesce(v, case when hp.m - {Z} * sqrt(hp.m * (1 - hp.m) / (total + 1)) >= {THRESHOLD} then 'block' else 'allow' end) as verdict
    from r join hp on r.host = hp.host"""
