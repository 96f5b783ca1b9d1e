"""Personal data: fixed patterns, and candidates that boosted trees choose.

Base spans are mail addresses, IPv4 addresses, card numbers and phone numbers by fixed patterns and checks; they always stay. Three
generators of high recall propose more, overlapping spans: ``mail`` (written-out or spaced addresses), ``call`` (numbers in groups without
a plus sign) and ``number`` (runs of nine or more digits). Gradient-boosted trees score a proposal by its format (digits, groups,
separators, check digit) and context (words before it, letters that touch it). A threshold per generator, calibrated on documents
that the trees did not learn from, selects those that are reported, unless a base span overlaps them.

Nothing is labelled, so the trees learn from what the patterns decide: a proposal inside an accepted base span is personal data, one that
meets a rejected match (a card number that fails its check, a phone number of the wrong length, an address part above 255) is not, others
are not learnt from. Learning takes all documents and all their proposals; equal ones count as one row with a weight. A generator whose
proposals never reach the wanted precision adds nothing. Learning and scoring are DataFrame work and MLlib's trees; the trees are applied
as column expressions.

Matches become positions by splitting at the same pattern: gaps and matches alternate. Running sums and maxima over the spans of a text go by
chunks of CHUNK, so a text may hold any number of spans. Patterns are possessive where that changes no match, so no run of characters is
walked twice.

Defined results: null counts as empty; offsets are code points, end exclusive; spans of all kinds may overlap each other; a text of any length is
scanned whole; repeated rows get equal answers; without documents to learn from only base spans are reported.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.tables import written

#: Share of right ones that a threshold must reach, and the least number of them.
PRECISION, LEAST = 0.95, 10
CHUNK, CONTEXT = 64, 24
#: Tasks of the learning.
PARTS = 16
BASE = ("email", "ip", "card", "phone")
ADDED = ("mail", "call", "number")

#: The patterns of the contract, possessive, and begun only where a leftmost match can begin.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "call": r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "number": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){8,}+",
}
#: Words that stand before personal data, or before other numbers.
BEFORE = {"reach": r"(?i)(?:tel|phone|call|mobile|fax|contact|appelez|anruf|telefon)[^A-Za-z]*$",
          "pay": r"(?i)(?:card|visa|account|iban|karte|konto|carte|tarjeta)[^A-Za-z]*$",
          "other": r"(?i)(?:token|key|sha|hash|commit|version|order|isbn|secret|id)[^A-Za-z]*$"}
FEATURES = ("kind", "size", "digits", "letters", "groups", "longest", "spaces", "dashes", "dots", "parens", "distinct", "first", "check", *BEFORE, "touched", "followed")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def check_digit(digits: Column) -> Column:
    """Whether a string of digits ends with its Luhn check digit."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = digits_of(value)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), check_digit(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def scan(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """What ``op`` makes of all values before each one (longs). Chunks first, then each chunk with what the ones before it give."""
    start = F.lit(zero).cast("long")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(CHUNK)).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(c, start, op))
    before = F.aggregate(totals, F.array(start), lambda a, t: F.concat(a, F.array(op(F.element_at(a, -1), t))))
    out = F.flatten(F.transform(chunks, lambda c, k: F.transform(c, lambda _, i: F.aggregate(F.slice(c, 1, i), F.get(before, k), op))))
    return F.when(F.size(values) > 0, out).otherwise(F.array().cast("array<bigint>"))


def add(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pieces(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Adds, per kind, its matches ``m_`` and the gaps around them ``g_``: size, last and first characters."""
    found = {k: F.col("text").rlike(PATTERNS[k]) for k in kinds}
    no_gap, no_match = "array<struct<n:bigint,tail:string,head:string>>", "array<string>"
    df = df.withColumns({f"has_{k}": F.coalesce(found[k], F.lit(False)) for k in kinds})
    made = {}
    for k in kinds:
        gaps = F.transform(F.split("text", PATTERNS[k], -1), lambda g: F.struct(
            F.length(g).cast("bigint").alias("n"), F.right(g, F.lit(CONTEXT)).alias("tail"), F.left(g, F.lit(1)).alias("head")))
        made[f"g_{k}"] = F.when(F.col(f"has_{k}"), gaps).otherwise(F.array().cast(no_gap))
        made[f"m_{k}"] = F.when(F.col(f"has_{k}"), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast(no_match))
    return df.withColumns(made).drop("text", *[f"has_{k}" for k in kinds])


def placed(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Adds, per kind, ``c_``: array of (start, k, end, value, tail, head), k the number of the kind."""
    sizes = {f"z_{k}": F.zip_with(F.slice(f"g_{k}", 1, F.size(f"m_{k}")), f"m_{k}", lambda g, m: g["n"] + F.length(m)) for k in kinds}
    df = df.withColumns(sizes)
    df = df.withColumns({f"o_{k}": scan(F.col(f"z_{k}"), 0, add) for k in kinds})

    def spans(k):
        number = F.lit((BASE + ADDED).index(k))
        return F.transform(f"m_{k}", lambda m, i: F.struct(
            (F.get(F.col(f"o_{k}"), i) + F.get(F.col(f"g_{k}"), i)["n"]).alias("start"), number.alias("k"), (F.get(F.col(f"o_{k}"), i) + F.get(F.col(f"z_{k}"), i)).alias("end"),
            m.alias("value"), F.get(F.col(f"g_{k}"), i)["tail"].alias("tail"), F.get(F.col(f"g_{k}"), i + 1)["head"].alias("head")))

    return df.withColumns({f"c_{k}": spans(k) for k in kinds}).drop(*[f"{p}_{k}" for p in "gmzo" for k in kinds])


def candidates(df: DataFrame) -> DataFrame:
    """``df`` (with text) with ``base`` (accepted), ``failed`` (rejected matches) and ``more`` (proposals with their features)."""
    df = placed(pieces(df.withColumn("text", F.coalesce("text", F.lit(""))), BASE + ADDED), BASE + ADDED)
    bare = lambda c: F.transform(c, lambda e: F.struct(e["start"], e["k"], e["end"]))
    good = [bare(F.filter(f"c_{k}", lambda e: holds(k, e["value"]))) for k in BASE]  # noqa: B023
    poor = [bare(F.filter(f"c_{k}", lambda e: ~holds(k, e["value"]))) for k in BASE]  # noqa: B023
    more = F.transform(F.concat(*[F.col(f"c_{k}") for k in ADDED]), lambda e: F.struct(e["start"], e["k"], e["end"], features(e).alias("f")))
    return df.withColumns({"base": F.sort_array(F.concat(*good)), "failed": F.concat(*poor), "more": more}).drop(*[f"c_{k}" for k in BASE + ADDED])


def features(e: Column) -> Column:
    """Format and context of a proposal, as an array of doubles in the order of FEATURES."""
    v = e["value"]
    digits = digits_of(v)

    def count(chars):
        return F.length(v) - F.length(F.translate(v, chars, ""))

    made = {"kind": e["k"], "size": F.length(v), "digits": F.length(digits), "letters": F.length(F.regexp_replace(v, "[^A-Za-z]", "")),
            "groups": F.size(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))),
            "longest": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), F.length)), F.lit(0)),
            "spaces": count(" "), "dashes": count("-"), "dots": count("."), "parens": count("()"), "distinct": F.size(F.array_distinct(F.split(digits, ""))),
            "first": F.coalesce(F.try_to_number(F.left(digits, F.lit(1)), F.lit("9")), F.lit(-1)),
            "check": F.when(F.length(digits).between(8, 19), check_digit(digits)).otherwise(False),
            **{name: e["tail"].rlike(words) for name, words in BEFORE.items()},
            "touched": e["tail"].rlike("[A-Za-z0-9_=/]$"), "followed": e["head"].rlike("^[A-Za-z0-9_=/]")}
    return F.array(*[F.coalesce(made[f].cast("double"), F.lit(0.0)) for f in FEATURES])


def marked(df: DataFrame) -> DataFrame:
    """``more`` with three flags: within an accepted base span, met by one, met by a rejected match.

    All spans of a text in order, by start; the furthest end before a span, and the nearest start behind it, tell.
    """
    base = F.transform("base", lambda e: F.struct(e["start"].alias("start"), F.lit(0).alias("o"), e["end"].alias("end"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("array<double>").alias("f")))
    poor = F.transform("failed", lambda e: F.struct(e["start"].alias("start"), F.lit(1).alias("o"), e["end"].alias("end"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("array<double>").alias("f")))
    more = F.transform("more", lambda e: F.struct(e["start"].alias("start"), F.lit(2).alias("o"), e["end"].alias("end"), e["k"].alias("k"), e["f"].alias("f")))
    far = 2**62
    df = df.withColumn("all", F.when(F.size("more") > 0, F.sort_array(F.concat(base, poor, more))).otherwise(F.slice(more, 1, 0)))
    ends = [F.transform("all", lambda e: F.when(e["o"] == o, e["end"]).otherwise(F.lit(-1)).cast("long")) for o in (0, 1)]  # noqa: B023
    starts = F.reverse(F.transform("all", lambda e: F.when(e["o"] == 0, e["start"]).otherwise(F.lit(far)).cast("long")))
    df = df.withColumns({"e0": scan(ends[0], -1, larger), "e1": scan(ends[1], -1, larger), "s0": F.reverse(scan(starts, far, smaller))})
    flagged = F.transform("all", lambda e, i: F.struct(
        e["start"].alias("start"), e["k"].alias("k"), e["end"].alias("end"), e["f"].alias("f"), e["o"].alias("o"), (F.get("e0", i) >= e["end"]).alias("inside"),
        ((F.get("e0", i) > e["start"]) | (F.get("s0", i) < e["end"])).alias("met"), (F.get("e1", i) > e["start"]).alias("failed")))
    return df.withColumn("more", F.filter(flagged, lambda e: e["o"] == 2)).drop("all", "e0", "e1", "s0", "failed")


class Model:
    """Trees as expressions, and a threshold per added kind."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, f: Column) -> Column:
        """Probability of personal data from an array of features."""
        def value(node):
            if not isinstance(node, tuple):
                return F.lit(node)
            at, limit, low, high = node
            return F.when(F.get(f, F.lit(at)) <= limit, value(low)).otherwise(value(high))

        margin = reduce(add, [value(t) * w for t, w in zip(self.trees, self.weights)])
        return 1 / (1 + F.exp(-2 * margin))

    def chosen(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``more``) with ``added``: (start, k, end, score) of the proposals that are reported."""
        limits = {(BASE + ADDED).index(k): t for k, t in self.thresholds.items() if t <= 1}
        if not limits:
            return df.withColumn("added", F.array().cast("array<struct<start:bigint,k:int,end:bigint,score:double>>"))
        scored = F.transform(F.filter("more", lambda e: ~e["met"]), lambda e: F.struct(e["start"].alias("start"), e["k"].alias("k"), e["end"].alias("end"), self.score(e["f"]).alias("score")))
        reach = lambda e: reduce(lambda a, b: a | b, [(e["k"] == k) & (e["score"] >= t) for k, t in limits.items()])
        return df.withColumn("added", F.filter(scored, reach))


NOTHING = Model([], [], {})


def tree_of(node):
    """A tree of MLlib as nested tuples (feature, limit, low, high) with numbers at the leaves."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), tree_of(node.leftChild()), tree_of(node.rightChild())


def found_in(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with its spans and the fold of its text."""
    return marked(candidates(docs.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(5)).cast("int"))))


def fit(docs: DataFrame, precision: float = PRECISION, least: int = LEAST) -> Model:
    """Trees from four fifths of the documents, thresholds from the rest."""
    return learn(found_in(docs.select("text")), precision, least)


def learn(known: DataFrame, precision: float = PRECISION, least: int = LEAST) -> Model:
    """The model of ``found_in``'s rows: all of them, equal proposals of a fold as one row of weight ``n``."""
    # explode_outer: explode would have Spark push a filter on the size down, which spells all expressions out many times over
    known = known.select("fold", F.explode_outer("more").alias("e")).filter("e.inside or e.failed")
    known = known.select("fold", "e.k", "e.f", F.col("e.inside").cast("double").alias("label"))
    known = known.groupBy("fold", "k", "f", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    known = written(known.repartition(PARTS, "f", "fold", "label").sortWithinPartitions("f", "fold", "label"), "pii-candidates")
    train, rest = known.filter("fold > 0"), known.filter("fold = 0")
    if train.select("label").distinct().count() < 2:
        return NOTHING
    rows = VectorAssembler(inputCols=[*FEATURES], outputCol="v").transform(train.select("label", "n", *[F.col("f")[i].alias(name) for i, name in enumerate(FEATURES)]))
    boosted = GBTClassifier(labelCol="label", featuresCol="v", weightCol="n", maxIter=12, maxDepth=3, stepSize=0.3, seed=11).fit(rows)
    trees = [tree_of(t._call_java("rootNode")) for t in boosted.trees]
    model = Model(trees, list(boosted.treeWeights), {})
    # the least score from which the held-out proposals are right often enough, per kind and hundredth
    steps = (rest.withColumn("s", F.floor(model.score(F.col("f")) * 100)).groupBy("k", "s").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect())
    for i, kind in enumerate(ADDED, len(BASE)):
        model.thresholds[kind], right, total = 2.0, 0.0, 0
        for r in sorted((r for r in steps if r.k == i), key=lambda r: -r.s):
            right, total = right + r.right, total + r.n
            if right >= least and right >= precision * total:
                model.thresholds[kind] = r.s / 100
    return model


def joined(spans: Column, names: Sequence[str]) -> Column:
    names = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda e: F.concat_ws(":", F.get(names, e["k"]), e["start"], e["end"])), ",")


def scan_texts(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, ``base`` and ``added`` spans: (start, k, end), by start, then kind. Without a model, one is learnt from these documents,
    whose spans are then found once and written."""
    bare = F.transform("added", lambda e: F.struct(e["start"], e["k"], e["end"]))
    found = found_in(docs.select("doc_id", "text"))
    if model is None:
        found = written(found, "pii-found")
        model = learn(found)
    return model.chosen(found).select("doc_id", "base", F.sort_array(bare).alias("added"))


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans."""
    out = scan_texts(docs, model)
    counts = [F.size(F.filter("base", lambda e: e["k"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]  # noqa: B023
    return out.select("doc_id", *counts, F.size("added").cast("long").alias("n_added"), F.sha2(joined(F.col("base"), BASE).cast("binary"), 256).alias("base_sha256"),
                      joined(F.sort_array(F.concat("base", "added")), BASE + ADDED).alias("spans"))
