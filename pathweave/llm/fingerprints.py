"""Order MinHash: fingerprints that follow the edit distance, as they keep the order of the chosen k-mers.

K-mers are KMER consecutive words (runs without white space, cut into pieces of PIECE characters), each numbered by how often it has
occurred before in the text. One hash deals them over BUCKETS. A bucket ranks its own k-mers by that hash and, behind them, all others of the text by a
hash of its own; it takes the LENGTH least, puts them in text order, and hashes that tuple. So long texts read each k-mer once, and in short texts,
where buckets have few k-mers of their own, the ranking of every bucket is an independent one over the whole text and order counts at every length.

Sorting is kept short by a first try with the hashes below a limit, at which a bucket expects FILL candidates; the buckets that get fewer than LENGTH that
way are ranked over all k-mers. FILL changes the work, not the result.

The likeness of two fingerprints is the share of buckets, of those filled in either, whose tuples are equal (1 for equal fingerprints, empty ones too).

Defined results: null counts as an empty text, whose fingerprint is empty; texts with fewer words than KMER are one k-mer, and
buckets of a text with fewer k-mers than LENGTH hash what there is. Documents are ordered by doc_id, null
as the least, equal ids by text; a row that repeats an id follows its twin. The only document of a table is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.llm.tables import documents

KMER, LENGTH, BUCKETS, FILL, PIECE = 3, 2, 64, 8, 12
#: Documents are put in order within buckets of 2^ID_BITS ids, these within 2^GROUP_BITS buckets.
ID_BITS, GROUP_BITS = 8, 12


def fingerprint(df: DataFrame, text: str, out: str, fill: int = FILL) -> DataFrame:
    """Add ``out``: one number per bucket (the bucket above 32 bits of the tuple's hash), by bucket; none for a text without words."""
    words, kmers, ranked, least, chosen, short, ordered = (
        f"__{out}_{x}" for x in ("words", "kmers", "ranked", "least", "chosen", "short", "ordered"))
    n = F.size(words)
    df = df.withColumn(words, F.regexp_extract_all(text, F.lit(r"\S{1,%d}" % PIECE), F.lit(0)))
    df = df.withColumn(kmers, F.when(n >= KMER, F.transform(
        F.sequence(F.lit(0), n - KMER), lambda i: F.xxhash64(*[F.col(words)[i + k] for k in range(KMER)]))).when(
        n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>")))
    # texts without a repeated k-mer need no sort to number them
    first = F.transform(kmers, lambda h, i: F.struct(F.xxhash64(h, F.lit(0)).alias("v"), i.alias("p")))
    df = df.withColumn(ranked, F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), first).otherwise(numbered(F.col(kmers))))
    low = let(rank_below(fill * BUCKETS, F.size(ranked)), lambda m: F.filter(ranked, lambda x: F.shiftrightunsigned(x.v, 11) < m))
    df = df.withColumn(least, F.sort_array(F.transform(low, lambda x: F.struct(
        own_bucket(x.v).alias("b"), F.shiftrightunsigned(x.v, 11).alias("r"), x.p.alias("p"), x.v.alias("v")))))
    df = df.withColumn(chosen, F.filter(least, lambda x, i: (i < LENGTH) | (F.get(F.col(least), i - LENGTH).b != x.b)))
    full = F.transform(F.filter(chosen, lambda x, i: F.get(F.col(chosen), i + LENGTH - 1).b == x.b), lambda x: x.b)
    every = F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS - 1).cast("long"))
    df = df.withColumn(short, F.when(F.size(ranked) == 0, F.array().cast("array<bigint>")).otherwise(F.array_except(every, full)))
    found = F.transform(chosen, lambda x: F.struct(x.b.alias("b"), F.lit(0).alias("far"), x.r.alias("r"), x.p.alias("p"), x.v.alias("v")))
    far = let(rank_below(fill, F.size(ranked)), lambda m: F.flatten(F.transform(short, lambda b: draw(F.col(ranked), b, m))))
    # a first try that left k-mers out has not seen all that are a bucket's own
    rest = F.when(F.size(ranked) > fill * BUCKETS, F.flatten(F.transform(short, lambda b: F.transform(
        F.filter(ranked, lambda x: own_bucket(x.v) == b),
        lambda x: F.struct(b.alias("b"), F.lit(0).alias("far"), F.shiftrightunsigned(x.v, 11).alias("r"), x.p.alias("p"), x.v.alias("v")))))).otherwise(
        F.slice(found, 1, 0))
    # what was found twice becomes neighbours
    df = df.withColumn(ordered, F.sort_array(F.concat(found, rest, far)))
    df = df.withColumn(ordered, F.filter(ordered, lambda x, i: (i == 0) | (F.get(F.col(ordered), i - 1) != x)))
    df = df.withColumn(ordered, F.filter(ordered, lambda x, i: (i < LENGTH) | (F.get(F.col(ordered), i - LENGTH).b != x.b)))
    df = df.withColumn(ordered, F.sort_array(F.transform(ordered, lambda x: F.struct(x.b.alias("b"), x.p.alias("p"), x.v.alias("v")))))
    own = F.filter(F.transform(ordered, lambda x, i: F.when(
        (i == 0) | (F.get(F.col(ordered), i - 1).b != x.b),
        F.shiftleft(x.b, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.transform(F.filter(
            F.slice(F.col(ordered), i + 1, LENGTH), lambda y: y.b == x.b), lambda y: y.v)), 32)))), lambda x: x.isNotNull())
    return df.withColumn(out, own).drop(words, kmers, ranked, least, chosen, short, ordered)


def own_bucket(v: Column) -> Column:
    return v.bitwiseAND(F.lit(BUCKETS - 1))


def rank_below(wanted: int, n: Column) -> Column:
    """The 53-bit rank below which ``wanted`` of n are expected."""
    return (F.least(F.lit(1.0), F.lit(float(wanted)) / F.greatest(n, F.lit(1))) * float(1 << 53)).cast("bigint")


def draw(ranked: Column, b: Column, m: Column) -> Column:
    """The LENGTH least k-mers of a text by the hash for bucket b, but for the bucket's own; those below rank m are tried first."""
    rank = lambda x: F.shiftrightunsigned(F.xxhash64(x.v, b), 11)
    few = F.filter(ranked, lambda x: rank(x) < m)
    least = let(few, lambda some: F.slice(F.sort_array(F.transform(
        F.when(F.size(some) < LENGTH, ranked).otherwise(some), lambda x: F.struct(rank(x).alias("r"), x.p.alias("p"), x.v.alias("v")))), 1, LENGTH))
    return F.transform(F.filter(least, lambda x: own_bucket(x.v) != b), lambda x: F.struct(
        b.alias("b"), F.lit(1).alias("far"), x.r.alias("r"), x.p.alias("p"), x.v.alias("v")))


def numbered(kmers: Column) -> Column:
    """Hashes of (k-mer, number of earlier occurrences) with positions: sorted by k-mer, each run of equals is counted through."""
    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1).h != F.get(s, i).h))
        return let(starts, lambda b: F.flatten(F.transform(b, lambda a, j: F.transform(
            F.sequence(F.lit(0), F.coalesce(F.get(b, j + 1), F.size(s)) - a - 1),
            lambda o: F.struct(F.xxhash64(F.get(s, a + o).h, o).alias("v"), F.get(s, a + o).p.alias("p"))))))

    return let(F.sort_array(F.transform(kmers, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), runs)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def likeness(a: str, b: str) -> Column:
    of = lambda c: F.transform(c, lambda x: F.shiftrightunsigned(x, 32))
    filled = F.size(F.array_union(of(a), of(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def shown(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def with_next(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """Add ``next_<c>`` of the row that follows in descending ``__id``, after the last the first.

    Windows see one bucket of ids each. The last row of a bucket takes the head of the next bucket that has rows; buckets are linked the
    same way within groups, and groups (one row per 2^20 ids) by one short window. ``columns`` should be all of ``df``: then all
    branches read one and the same shuffle.
    """
    bucket, group = F.shiftright("__id", ID_BITS), F.shiftright("__bucket", GROUP_BITS)
    w = W.partitionBy("__bucket").orderBy(F.col("__id").desc(), *order)
    rows = df.withColumn("__bucket", bucket).withColumns({
        **{f"next_{c}": F.lead(c).over(w) for c in columns}, "__first": F.lag(F.lit(True)).over(w).isNull(), "__last": F.lead(F.lit(True)).over(w).isNull()})
    inside = rows.filter(~F.col("__last"))
    heads = rows.filter("__first").select(F.col("__bucket").alias("__head"), *[F.col(c).alias(f"next_{c}") for c in columns])
    buckets = df.select(bucket.alias("__bucket")).distinct().withColumn("__group", group)
    down = W.partitionBy("__group").orderBy(F.desc("__bucket"))
    linked = buckets.withColumn("__head", F.lead("__bucket").over(down))
    groups = buckets.groupBy("__group").agg(F.max("__bucket").alias("__top"))
    whole = W.partitionBy(F.lit(0)).orderBy(F.desc("__group"))
    circle = groups.select("__group", F.coalesce(F.lead("__top").over(whole), F.first("__top").over(whole)).alias("__below"))
    links = linked.join(circle, "__group").select("__bucket", F.coalesce("__head", "__below").alias("__head"))
    ends = rows.filter("__last").drop(*[f"next_{c}" for c in columns]).join(links, "__bucket").join(heads, "__head")
    return inside.select(*df.columns, *[f"next_{c}" for c in columns]).union(ends.select(*df.columns, *[f"next_{c}" for c in columns]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id."""
    least = F.lit(-(1 << 63))  # stands for null
    # only computed columns: a bare one is renamed in one branch of the union, which then doesn't share the shuffle of the others
    own = documents(docs).select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", least).alias("__id"))
    own = fingerprint(own, "text", "fp")
    both = with_next(own, ["text", "__id", "fp"], [F.col("text")])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))).drop("next_text")
    both = fingerprint(both, "edited", "fe")
    return both.select(
        F.nullif("__id", least).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("fp").alias("fingerprint"),
        shown("fe").alias("edited_fingerprint"), likeness("fp", "fe").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), F.nullif("next___id", least).alias("next_doc_id"))
