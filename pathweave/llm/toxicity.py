"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learnt from labelled rows: whole words and word beginnings whose presence speaks for the label (log odds
over their standard error). Features are the density and strength of lexicon hits, their closeness to second-person
words, and the rates of capitals, punctuation, marks of emphasis, digits and words with obfuscated letters.

Labelled rows are cut into folds. A labelled row gets features from a lexicon that was learnt without its fold, so the trees
see hits as a new text would have them. Trees learn on all folds but one, the isotonic curve on that one.

Learning takes at most ``max_labelled`` rows (by hash of the id), the parameter that bounds all memory and broadcasts of the fit. Scoring covers
every row and whole texts. Defined results: a null text counts as empty and gets a score like any text; labels without a
document or value are ignored; of contradicting labels of a document toxic wins; with only one class to learn from
every score is that class's share (0 without labels); repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.tables import documents, with_results, written
from pathweave.llm.text import LETTERED, Block, blocks, byte_class, find_words

MAX_LABELLED = 20_000
#: Longest lexicon per fold; the strongest terms stay.
MAX_TERMS = 5_000
FOLDS = 5
PREFIXES = range(3, 7)
LONGEST_TERM = 40
#: Counts that a task holds before it passes them on.
HELD = 150_000
WEAK, STRONG, MIN_DOCS = 2.6, 4.0, 4
#: Log odds count up to here; beyond, they tell more about the number of labelled rows than about the word.
MOST_ODDS = 5.0
NEAR_BYTES = 60

#: Words that address somebody.
SECOND_PERSON = ("you your yours yourself du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
                 "tú ti tus contigo usted ustedes vosotros").split()

FEATURES = ("hit_density", "hit_log", "hit_kinds", "strong_log", "strong_density", "best", "weight_density", "near_second_person",
            "second_person", "capitals", "capital_words", "punctuation", "emphasis", "digits", "obfuscated", "words_log")
FIELDS = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])

_FOLD = bytes(b + 32 if 65 <= b <= 90 else (b if LETTERED[b] else 32) for b in range(256))
_UPPER = byte_class(lambda b: 0x41 <= b <= 0x5A)
_LOWER = byte_class(lambda b: 0x61 <= b <= 0x7A)
_DIGIT = byte_class(lambda b: 0x30 <= b <= 0x39)
_PUNCT = byte_class(lambda b: b < 0x80 and not LETTERED[b] and b > 0x20)
_MASKING = byte_class(lambda b: 0x30 <= b <= 0x39 or chr(b) in "@$*#!")


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def plain(text: bytes) -> str:
    """Lower-case words with single bytes as characters, separated and enclosed by spaces."""
    return " " + text.translate(_FOLD).decode("latin-1") + " "


def terms_of(text: bytes) -> set[str]:
    """Lexicon candidates: ' word ' for whole words, ' beg' for beginnings."""
    out = set()
    for w in set(plain(text).split(" ")):
        if w:
            if len(w) <= LONGEST_TERM:
                out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return out


@dataclass
class Lexicon:
    """Terms with log odds and whether they are strong, as a search automaton."""

    terms: dict[str, tuple[float, bool]]

    def __post_init__(self):
        self.automaton = None

    def search(self, text: str):
        """(start, end, log odds, strong) of hits, and starts of second-person words."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            second = {f" {w} ".encode().decode("latin-1") for w in SECOND_PERSON}
            for term in second | set(self.terms):
                self.automaton.add_word(term, (len(term), *self.terms.get(term, (0.0, False)), term in second, term))
            self.automaton.make_automaton()
        hits, second = {}, []
        for end, (size, odds, strong, person, term) in self.automaton.iter(text):
            start = end - size + 1
            if person:
                second.append(start)
            if odds > 0 and odds > hits.get(start, (0.0,))[0]:
                hits[start] = (odds, strong, term)
        return hits, second

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.terms, self.automaton = terms, None


def features(block: Block, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per document of the block."""
    data, n = block.data, block.n
    words = find_words(block, LETTERED)
    n_words = np.diff(words.first)
    bounds = block.offsets

    def rate(flags, per=None):
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, np.diff(bounds) if per is None else per)

    def per_word(flags):
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(1, n_words)

    upper = _UPPER[data]
    uppers = np.concatenate([[0], np.cumsum(upper)])
    shouted = (uppers[words.ends] - uppers[words.starts] == words.ends - words.starts) & (words.ends - words.starts > 1)
    letter = upper | _LOWER[data]
    masked = np.zeros(len(data), bool)
    masked[1:-1] = letter[:-2] & _MASKING[data][1:-1] & letter[2:]
    lower_letters = rate(letter, 1)
    hits, second = lexicon.search(plain(data.tobytes()))
    out = np.zeros((n, len(FEATURES)))
    if hits:
        at = np.array(sorted(hits))
        odds, strong, terms = (np.array(x) for x in zip(*(hits[k] for k in at.tolist())))
        # the text is searched with one space before it, so a hit's position is that of its first letter in the block
        doc = np.minimum(np.searchsorted(bounds, at, "right") - 1, n - 1)
        near = np.zeros(len(at), bool)
        if second:
            persons = np.array(second)
            k = np.searchsorted(persons, at)
            for side in (np.maximum(k - 1, 0), np.minimum(k, len(persons) - 1)):
                near |= (np.abs(persons[side] - at) <= NEAR_BYTES) & (np.searchsorted(bounds, persons[side], "right") - 1 == doc)
        count = np.bincount(doc, minlength=n)
        strength = np.bincount(doc, odds * strong, minlength=n)
        out[:, 0] = count / np.maximum(1, n_words)
        out[:, 1] = np.log1p(count)
        for i, k in Counter(d for d, _ in set(zip(doc.tolist(), terms.tolist()))).items():
            out[i, 2] = np.log1p(k)
        out[:, 3] = np.log1p(np.bincount(doc, strong, minlength=n))
        out[:, 4] = strength / np.maximum(1, n_words)
        np.maximum.at(out[:, 5], doc, odds)
        out[:, 6] = np.bincount(doc, odds, minlength=n) / np.maximum(1, n_words)
        out[:, 7] = np.bincount(doc, near, minlength=n) / np.maximum(1, count)
    if second:
        out[:, 8] = np.bincount(np.minimum(np.searchsorted(bounds, np.array(second), "right") - 1, n - 1), minlength=n) / np.maximum(1, n_words)
    out[:, 9] = rate(upper, 1) / np.maximum(1, lower_letters)
    out[:, 10] = per_word(shouted)
    out[:, 11] = rate(_PUNCT[data])
    out[:, 12] = rate((data == 0x21) | (data == 0x3F))
    out[:, 13] = rate(_DIGIT[data])
    out[:, 14] = rate(masked, np.maximum(1, n_words))
    out[:, 15] = np.log1p(n_words)
    return out


def with_features(df: DataFrame, lexicons: list[Lexicon], fold: str | None = None, column: str = "tox") -> DataFrame:
    """Add the struct of FEATURES; with ``fold``, row by row from the lexicon of that fold, else from the last one."""
    sent = df.sparkSession.sparkContext.broadcast(lexicons)

    def start():
        def compute(texts, folds=None):
            if folds is None:
                rows = [features(b, sent.value[-1]) for b in blocks(texts)]
            else:
                rows = [features(b, sent.value[f]) for t, f in zip(texts, folds.to_pylist()) for b in blocks(pa.array([t.as_py()], pa.string()))]
            made = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            return [pa.array(np.ascontiguousarray(made[:, k])) for k in range(len(FEATURES))]

        return compute

    return with_results(df, column, FIELDS, start, ("text", fold) if fold else ("text",))


def sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Labelled rows to learn from: doc_id, text, toxic, fold. At most ``max_labelled`` ids, so they can be broadcast."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    n = known.count()
    rank = F.xxhash64("doc_id", F.lit("labelled"))
    if n > max_labelled:
        share = min(1.0, 1.05 * max_labelled / n)
        known = known.filter(F.pmod(rank, F.lit(1_000_003)) < int(share * 1_000_003)).orderBy(rank).limit(max_labelled)
    rows = docs.join(F.broadcast(known), "doc_id")
    # one row per text, and the fold by text, so that copies neither count twice nor meet themselves in another fold
    rows = rows.groupBy(F.xxhash64("text").alias("h"), F.md5(F.col("text").cast("binary")).alias("m")).agg(
        F.min_by(F.struct("doc_id", "text"), "doc_id").alias("r"), F.max("toxic").alias("toxic"))
    return rows.select("r.doc_id", "r.text", "toxic", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """One lexicon without each fold, and one from all rows."""
    schema = T.StructType([T.StructField("term", T.BinaryType()), T.StructField("fold", T.IntegerType()),
                           T.StructField("toxic", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, fold, toxic in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seen.update((t, fold, toxic) for t in terms_of((text or "").encode()))
                if len(seen) > HELD:
                    yield packed(seen)
                    seen.clear()
        yield packed(seen)

    def packed(seen):
        return pa.RecordBatch.from_arrays([
            pa.array([k[0].encode("latin-1") for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.int32()),
            pa.array([k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], schema.names)

    texts = rows.select("text", "fold", "toxic")
    totals = {(r.fold, r.toxic): r.n for r in texts.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = texts.mapInArrow(count, schema).groupBy("term").agg(*[
        F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{y}{f}") for y in (0, 1) for f in range(FOLDS)])
    counted = written(counted.filter(sum(F.col(f"n1{f}") for f in range(FOLDS)) >= MIN_DOCS), "terms")
    out = []
    for left_out in [*range(FOLDS), None]:
        folds = [f for f in range(FOLDS) if f != left_out]
        n0, n1 = (sum(totals.get((f, y), 0) for f in folds) for y in (0, 1))
        c0, c1 = (sum(F.col(f"n{y}{f}") for f in folds) for y in (0, 1))
        odds = F.log((c1 + 0.5) / (n1 - c1 + 0.5)) - F.log((c0 + 0.5) / (n0 - c0 + 0.5))
        z = odds / F.sqrt(1 / (c0 + 0.5) + 1 / (c1 + 0.5))
        best = (counted.select("term", odds.alias("odds"), z.alias("z"), c1.alias("c1")).filter((F.col("z") >= WEAK) & (F.col("c1") >= MIN_DOCS))
                .orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect())
        terms = {bytes(r.term).decode("latin-1"): (min(r.odds, MOST_ODDS), r.z >= STRONG) for r in best}
        # a term says nothing that a shorter beginning says as well
        out.append(Lexicon({t: v for t, v in terms.items() if not any(terms.get(t[:k], (0, 0))[0] >= v[0] - 0.5 for k in range(4, len(t)))}))
    return out


@dataclass
class Model:
    """Lexicon, trees and calibration; ``share`` alone where only one class was seen."""

    lexicon: Lexicon | None
    trees: object
    curve: object
    share: float

    def score(self, df: DataFrame, column: str = "score") -> DataFrame:
        """``df`` with the calibrated probability of label 1 (0 to 1)."""
        if self.trees is None:
            return df.withColumn(column, F.lit(self.share))
        out = assembled(with_features(df, [self.lexicon], column="__tox")).drop("__tox")
        out = self.trees.transform(out).withColumn("__p", vector_to_array("__probability")[1])
        return self.curve.transform(out).withColumn(column, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__score")))).drop(
            "__features", "__raw", "__probability", "__prediction", "__p", "__score")


def assembled(df: DataFrame, column: str = "__tox") -> DataFrame:
    return VectorAssembler(inputCols=[f"{column}.{f}" for f in FEATURES], outputCol="__features").transform(df)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the labelled rows that are not held out."""
    rows = written(sample(documents(docs), labels, max_labelled), "labelled")
    counts = dict(rows.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return Model(None, None, None, float(counts.get(1, 0) > 0))
    lexicons = learn_lexicons(rows)
    made = written(with_features(rows.select("doc_id", "text", "toxic", "fold"), lexicons, "fold", "__tox").select(
        F.col("toxic").cast("double").alias("toxic"), "fold", "__tox").repartition(4), "features")
    train = assembled(made)
    part, rest = train.filter(F.col("fold") != 0), train.filter(F.col("fold") == 0)
    if part.select("toxic").distinct().count() < 2 or rest.select("toxic").distinct().count() < 2:
        part = rest = train
    boosting = GBTClassifier(labelCol="toxic", featuresCol="__features", predictionCol="__prediction", maxIter=15, maxDepth=3, stepSize=0.3, seed=7)
    trees = boosting.setRawPredictionCol("__raw").setProbabilityCol("__probability").fit(part)
    scored = trees.transform(rest).withColumn("__p", vector_to_array("__probability")[1])
    curve = IsotonicRegression(labelCol="toxic", featuresCol="__p", predictionCol="__score").fit(scored)
    return Model(lexicons[-1], trees, curve, 0.0)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, max_labelled)
    return model.score(documents(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    return fit(docs, labels, max_labelled).score(docs, "__toxic").filter(F.col("__toxic") < threshold).drop("__toxic")
