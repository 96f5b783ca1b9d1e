"""MinHash near-dedup with DartMinHash signatures.

A document is a weighted set: its shingles of five words and how often each occurs. Darts are thrown by hashing into
the plane of (weight, rank) above every shingle: the weight axis is cut into the regions [0,1), [1,2), [2,4), [4,8) and so on, in each
region darts arrive along the rank axis at exponential distances, and each carries a place within the region and a coordinate. A document
catches the darts below its weights and below a rank chosen so that about k ln k + 2k are caught; if a coordinate stays empty, the rank
is doubled. The earliest dart of each coordinate is the signature; two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Bands of coordinates are joined, and every joined pair is checked exactly on its shingles.

Equal texts are one class from the start, so copies are never paired. Within a band only pairs with its
most central member are formed. Members that share a band but no component after that are joined by their rarest shingles, one of
which similar documents must share, so that no link that the bands show is lost, whatever the size of a band.

Defined results: words are runs of digits, letters and characters beyond ASCII, lower-cased in ASCII; a text of one to four words is one
shingle; a null text, a text without words and a row without doc_id belong to no group; rows of one doc_id are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.components import components
from pathweave.llm.tables import documents, written
from pathweave.llm.text import LETTERED, Block, blocks, find_words, lower_ascii, mix, range_hashes, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: 28 bands of 6 coordinates find a pair of similarity 0.8 with probability 0.9998.
BANDS, ROWS_PER_BAND = 28, 6

_LOWER = lower_ascii().astype(np.uint8)
_U = np.uint64


def shingles(block: Block, size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of the distinct shingles of each document."""
    words = find_words(block, LETTERED, _LOWER)
    at, hashes = window_hashes(words, size)
    cuts = np.searchsorted(at, words.first)
    out = []
    for i in range(block.n):
        a, b = words.first[i], words.first[i + 1]
        own = hashes[cuts[i] : cuts[i + 1]] if b - a >= size else range_hashes(words.hashes[a:b], np.zeros(int(b > a), int), np.full(int(b > a), b - a))
        out.append(np.unique(own, return_counts=True))
    return out


def regions(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per region that a weight reaches: row of the element, number of the region, its width, share of it below the weight."""
    rows, number, width, share = [], [], [], []
    low, high, k = 0.0, 1.0, 0
    at = np.arange(len(elements))
    while len(at):
        rows.append(at)
        number.append(np.full(len(at), k, np.uint64))
        width.append(np.full(len(at), high - low))
        share.append(np.minimum(1.0, (weights[at] - low) / (high - low)))
        low, high, k = high, 2 * high, k + 1
        at = at[weights[at] > low]
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (rows, number, width, share))


def uniform(keys: np.ndarray) -> np.ndarray:
    return ((keys >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def throw(elements: np.ndarray, weights: np.ndarray, limit: np.ndarray, coordinates: int, seed: int):
    """Darts caught below ``weights`` and below the rank ``limit`` of each element: (row, coordinate, rank, dart)."""
    row, number, width, share = regions(elements, weights)
    row = row.astype(np.int64)
    region = mix(elements[row] + mix(number.astype(np.uint64) + _U(seed)))
    rank, out = np.zeros(len(row)), []
    turn = 0
    while len(row):
        key = mix(region + _U((turn * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        rank = rank - np.log(uniform(key)) / width
        live = rank < limit[row]
        row, region, width, share, rank, key = (x[live] for x in (row, region, width, share, rank, key))
        inside = (share >= 1.0) | (uniform(mix(key + _U(1))) < share)
        dart = mix(key + _U(2))
        out.append((row[inside], (dart[inside] % _U(coordinates)).astype(np.int64), rank[inside], dart[inside]))
        turn += 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.uint64))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], coordinates: int, seed: int = 1) -> np.ndarray:
    """Earliest dart per coordinate, one row per non-empty weighted set (elements, weights)."""
    wanted = coordinates * np.log(coordinates) + 2 * coordinates
    out = np.zeros((len(sets), coordinates), np.uint64)
    limits = np.array([wanted / max(w.sum(), 1e-300) for _, w in sets])
    todo = np.arange(len(sets))
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        row, coordinate, rank, dart = throw(elements, weights, limits[todo][owner], coordinates, seed)
        slot = owner[row] * coordinates + coordinate
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        made = np.zeros(len(todo) * coordinates, np.uint64)
        filled = np.zeros(len(todo) * coordinates, bool)
        made[slot[first]], filled[slot[first]] = dart[first], True
        full = filled.reshape(-1, coordinates).all(axis=1)
        out[todo[full]] = made.reshape(-1, coordinates)[full]
        todo = todo[~full]
        limits[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, different for equal contents of different bands."""
    n = len(signature)
    parts = signature.reshape(n, bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for r in range(parts.shape[2]):
        key = mix(key * _U(3) + parts[:, :, r])
    return key


def signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest of the text, keys of its bands; documents without shingles are left out."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1), 1 << 19):
                sets = shingles(block, size)
                have = [i for i, s in enumerate(sets) if len(s[0])]
                keys = band_keys(signatures([sets[i] for i in have], bands * rows), bands) if have else np.zeros((0, bands), np.uint64)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([block.first + i for i in have], pa.int64())),
                    pa.array([hashlib.md5(block.text(i), usedforsecurity=False).digest() for i in have], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))], ["doc_id", "digest", "keys"])

    return docs.filter("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, digest binary, keys array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (elements, counts) with sorted elements."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / max(1, a[1].sum() + b[1].sum() - common))


def checked(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose texts are similar, by their shingles."""
    own = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    other = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                # the same text often comes in a row: its shingles are counted once
                sides = []
                for k in (2, 3):
                    distinct = part.column(k).dictionary_encode()
                    sets = [s for block in blocks(distinct.dictionary) for s in shingles(block, size)]
                    sides.append([sets[j] for j in distinct.indices.to_pylist()])
                keep = pa.array([similarity(x, y) >= threshold for x, y in zip(*sides)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return pairs.join(own, "a").join(other, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def own_key(column: str):
    """The column under an expression of its own: a join on it gets exchanges on both sides, whose hot keys Spark can split."""
    return F.col(column).bitwiseXOR(F.lit(0).cast("long")).alias(column)


def numbered(texts: DataFrame, size: int) -> DataFrame:
    """(rep, n, element): the shingles of each text, each occurrence numbered, so that sets of them compare as the weights do."""
    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1), 1 << 18):
                made = []
                for h, count in shingles(block, size):
                    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    made.append(mix(np.repeat(h, count) + turn.astype(np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(made, pa.list_(pa.int64()))], ["rep", "elements"])

    rows = texts.select("doc_id", "text").mapInArrow(run, "rep long, elements array<long>")
    return rows.select("rep", F.size("elements").alias("n"), F.explode("elements").alias("element"))


def by_rare_shingles(texts: DataFrame, labels: DataFrame, size: int, threshold: float) -> DataFrame:
    """All pairs (a, b) of different labels that can be similar. Two sets of n elements, ordered from rare to common, share one of
    their first n - threshold n + 1 if they are similar, so only those are joined: what many documents have in common comes last.
    """
    of = written(numbered(texts, size), "elements")
    counts = of.groupBy("element").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").select(own_key("element"), "f")
    # an element of its own cannot be shared: it only takes a place at the front
    shared = of.join(counts, "element").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("f", "element"))).alias("s"))
    alone = F.col("n") - F.size("s")
    places = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - alone
    front = shared.filter(places > 0).select("rep", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), places.cast("int"))).alias("at", "e"))
    # left: elements of the set from this one on
    front = front.select("rep", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("e.element").alias("element"))
    front = written(front.join(labels, "rep"), "fronts")
    one, two = (front.select("element", F.col("rep").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}"), F.col("left").alias(f"r{x}")) for x in "ab")
    # what two sets share lies behind the first element that they share
    enough = F.least("ra", "rb") >= (F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-9
    return one.join(two.withColumn("element", own_key("element")), "element").filter(F.expr("a < b and la <> lb") & enough).select("a", "b").distinct()


def linked(bands: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Checked links (a, b) that join all members of each band that are similar, directly or through others.

    First every member meets the most central one of its band (by the sizes of all bands it is in). Members of a band that are
    then in different components are compared by their rare shingles.
    """
    leader = bands.groupBy("band").agg(F.max_by("rep", F.struct("weight", "rep")).alias("a")).select(own_key("band"), "a")
    pairs = bands.join(leader, "band").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()
    edges = written(checked(pairs, texts, size, threshold), "links")
    known = bands.join(components(edges).withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
    split = known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select(own_key("band"))
    apart = written(known.join(split, "band").select("rep", "label").distinct(), "apart")
    rest = texts.join(apart.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    more = written(by_rare_shingles(rest, apart, size, threshold), "rare")
    return edges.union(checked(more, texts, size, threshold))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS_PER_BAND) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_class (least doc_id with that text), class_id (least doc_id of the group)."""
    docs = documents(docs)
    own = written(signed(docs, size, bands, rows), "signatures")
    classes = written(own.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "texts")
    members = own.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    in_bands = classes.select("rep", F.explode("keys").alias("band")).distinct()
    shared = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(in_bands.join(shared.select(own_key("band"), "n"), "band"), "shared")
    weights = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    buckets = written(shared.join(weights, "rep").select("band", "rep", "weight"), "bands")
    texts = written(docs.join(weights.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), "candidates")
    labels = components(linked(buckets, texts, size, threshold))
    groups = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("rep").alias("text_class"), F.coalesce("label", "rep").alias("class_id"))
    return docs.select("doc_id").join(groups, "doc_id", "left").select(
        "doc_id", F.coalesce("text_class", "doc_id").alias("text_class"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay: one row per group, that of the least doc_id; rows in no group all stay."""
    groups = near_duplicates(docs, **params).filter("doc_id is not null")
    groups = written(groups.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "groups")
    # the list grows with the documents: one kind of join at every size, none that turns from broadcast to shuffle
    gone = groups.filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).hint("merge")
    kept = docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
    again = groups.filter("doc_id = class_id and n > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return kept
    # rows that share one doc_id: of rows with words the first by content stays
    own = kept["doc_id"].cast("long") == F.col("__again")
    repeated = kept.join(again, own, "left_semi")
    has_words = F.coalesce(F.regexp_like("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")), F.lit(False))
    names = [f"`{c}`" for c in docs.columns]
    one = repeated.filter(has_words).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("__row")).select("__row.*")
    return kept.join(again, own, "left_anti").union(repeated.filter(~has_words)).union(one)
