"""Benchmark decontamination: Wu-Manber search for test passages, in units of words.

Patterns are all windows of ``window`` consecutive words of a benchmark item; an item with fewer words is one pattern.
Patterns of one length share a shift table over hashed word pairs: the pair that ends at a text position says how far the
search may jump before any pattern can end. Where it says zero, the bucket of that pair as a pattern suffix lists the
test strings, whose words are compared one by one, at last as bytes. The search runs over many text segments in lock step.

Defined results: a null or empty text has no words; words are compared after A-Z became a-z; a repeated row gets the same
answer as its twin; an empty benchmark leaves every document clean; benchmark rows without words or id never match.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.tables import with_results, written
from pathweave.llm.text import LETTERED, Block, blocks, find_words, lower_ascii, mix

#: Words of benchmark text in one broadcast table (some 100 bytes each). A larger benchmark is searched for in several passes.
SHARD_WORDS = 200_000
SHIFT_BITS = 18
SEGMENT = 256

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])

_LOWER = lower_ascii().astype(np.uint8)


def pair_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` (1 or 2) words that ends at each position."""
    if size == 1:
        return hashes[at]
    return mix(hashes[at - 1] * np.uint64(3) + hashes[at])


@dataclass
class PatternSet:
    """All patterns of one length, ordered by the hash of their suffix block."""

    length: int
    block: int
    shift: np.ndarray
    suffix: np.ndarray  # sorted
    words: np.ndarray  # hashes, one row per pattern
    texts: list[bytes]
    item: np.ndarray


def pattern_sets(items: list[tuple[str, str]], window: int) -> tuple[list[str], list[PatternSet]]:
    """Shift tables and suffix buckets from (item_id, text) pairs."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    found: dict[int, dict[tuple[bytes, int], np.ndarray]] = {}
    column = pa.array([t for _, t in items], pa.string())
    for block in blocks(column):
        words = find_words(block, LETTERED, _LOWER)
        lowered = _LOWER[block.data].tobytes()
        for i in range(block.n):
            a, b = words.first[i], words.first[i + 1]
            size = min(window, b - a)
            for s in range(a, b - size + 1 if size else a):
                text = b" ".join(lowered[words.starts[k] : words.ends[k]] for k in range(s, s + size))
                found.setdefault(int(size), {})[text, number[items[block.first + i][0]]] = words.hashes[s : s + size]
    sets = []
    for size, patterns in sorted(found.items()):
        matrix = np.array(list(patterns.values()), np.uint64)
        width = min(2, size)
        shift = np.full(1 << SHIFT_BITS, size - width + 1, np.uint8 if size < 200 else np.int64)
        for end in range(width - 1, size):
            slots = pair_hashes(matrix.ravel(), np.arange(len(matrix)) * size + end, width) & np.uint64((1 << SHIFT_BITS) - 1)
            shift[slots] = np.minimum(shift[slots], size - 1 - end)
        suffix = pair_hashes(matrix.ravel(), np.arange(len(matrix)) * size + size - 1, width)
        order = np.argsort(suffix, kind="stable")
        keys = list(patterns)
        sets.append(PatternSet(size, width, shift, suffix[order], matrix[order], [keys[k][0] for k in order],
                               np.array([keys[k][1] for k in order])))
    return names, sets


def search(hashes: np.ndarray, first: np.ndarray, patterns: PatternSet) -> tuple[np.ndarray, np.ndarray]:
    """(position of the last word, pattern) of every place where all word hashes agree."""
    m = patterns.length
    # segments overlap by m - 1 words, so that every alignment lies in exactly one of them
    starts = [np.arange(a, b - m + 1, SEGMENT) for a, b in zip(first[:-1], first[1:]) if b - a >= m]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.repeat([b for a, b in zip(first[:-1], first[1:]) if b - a >= m], [len(s) for s in starts])
    begin = np.concatenate(starts)
    stop = np.minimum(begin + SEGMENT + m - 1, ends)
    pos = begin + m - 1
    mask, places = np.uint64((1 << SHIFT_BITS) - 1), []
    while len(pos):
        step = patterns.shift[pair_hashes(hashes, pos, patterns.block) & mask].astype(np.int64)
        places.append(pos[step == 0])
        pos = pos + np.maximum(step, 1)
        live = pos < stop
        pos, stop = pos[live], stop[live]
    at = np.sort(np.concatenate(places))
    suffix = pair_hashes(hashes, at, patterns.block)
    low, high = np.searchsorted(patterns.suffix, suffix, "left"), np.searchsorted(patterns.suffix, suffix, "right")
    out_at, out_pattern = [], []
    # one candidate of each bucket at a time, so that large buckets need no more memory than small ones
    while len(at):
        live = low < high
        at, low, high = at[live], low[live], high[live]
        same = (hashes[at[:, None] + np.arange(1 - m, 1)] == patterns.words[low]).all(axis=1) if len(at) else np.zeros(0, bool)
        out_at.append(at[same])
        out_pattern.append(low[same])
        low = low + 1
    return np.concatenate(out_at or [at]).astype(np.int64), np.concatenate(out_pattern or [at]).astype(np.int64)


def scan_block(block: Block, names: list[str], sets: list[PatternSet]):
    """Per document: number of words, flags of the hit words, names of the items found."""
    words = find_words(block, LETTERED, _LOWER)
    n = len(words.starts)
    cover = np.zeros(n + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(block.n)]
    for patterns in sets:
        m = patterns.length
        for at, k in zip(*search(words.hashes, words.first, patterns)):
            text = b" ".join(_LOWER[block.data[words.starts[w] : words.ends[w]]].tobytes() for w in range(at - m + 1, at + 1))
            if text == patterns.texts[k]:
                cover[at - m + 1] += 1
                cover[at + 1] -= 1
                items[int(np.searchsorted(words.first, at, "right")) - 1].add(names[patterns.item[k]])
    hit = np.cumsum(cover[:n]) > 0
    return [(int(b - a), hit[a:b], items[i]) for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:]))]


def with_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, column: str = "passages") -> DataFrame:
    """``docs`` with a struct: n_words, n_hit (words inside test passages), hits (bits per word), items (ids, sorted).

    The benchmark is counted first. Up to SHARD_WORDS words are one broadcast table; a larger one is divided by item and
    the documents pass through one search per share, written between the passes.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
             .dropna().distinct())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // (SHARD_WORDS * 5)))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    spark = docs.sparkSession
    for shard in range(shards):
        share = [(r.item_id, r.text) for r in items.filter(F.col("shard") == shard).collect()]  # bounded by SHARD_WORDS
        sent = spark.sparkContext.broadcast(pattern_sets(share, window))

        def start(sent=sent):
            names, sets = sent.value

            def compute(texts, earlier=None):
                found = [row for block in blocks(texts) for row in scan_block(block, names, sets)]
                if earlier is not None:
                    found = [(n, hit | np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool), ids | set(more))
                             for (n, hit, ids), bits, more in zip(found, *(earlier.field(k).to_pylist() for k in ("hits", "items")))]
                return [pa.array([n for n, _, _ in found], pa.int64()), pa.array([int(h.sum()) for _, h, _ in found], pa.int64()),
                        pa.array([np.packbits(h).tobytes() for _, h, _ in found], pa.binary()),
                        pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string()))]

            return compute

        docs = with_results(docs, column, FIELDS, start, ("text", column) if shard else ("text",))
        if shard:
            docs = written(docs, "passages")
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    p = with_passages(docs.select("doc_id", "text"), benchmark, window)
    return p.select("doc_id", "passages.n_words", "passages.n_hit", F.size("passages.items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("passages.items", ",").cast("binary"), 256).alias("items_sha256"),
                    (F.col("passages.n_hit") > 0).alias("contaminated"))
