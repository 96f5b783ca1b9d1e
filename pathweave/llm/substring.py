"""Substring dedup: repeated passages of at least ``window`` words, found in prefix-partitioned suffix trees.

A suffix tree over all words doesn't fit one machine, and most suffixes repeat nothing. So the tree is sparse: of every
window one suffix is kept, the one that starts at the window's anchor, its least-hashed run of ANCHOR words. Equal windows have
equal anchors, so every repeat shows among the suffixes of one anchor. The anchor's words are the prefix that splits the suffixes
into groups; anchors that occur once repeat nothing and are dropped before any text moves. A group of at most GROUP suffixes is one
task's subtree: its windows are sorted, neighbours compared, and where the common prefix reaches ``window`` words (an internal node of
that depth) the leaves are occurrences of one repeat. A group above that gets the longest useful prefix, the whole window; such a
group is one deep node already, so its first occurrence is a minimum that is combined before the shuffle, and no task holds the group.

Equal texts are told apart first: only the least doc_id of a text can hold a first occurrence, so the other copies are covered
as a whole (if they have ``window`` words) and never enter a tree.

Defined results: words are divided by ASCII white space and stay unchanged; null has no words; texts below ``window`` words keep
all; rows that repeat a doc_id with its text are one document and get equal answers; rows of one doc_id with other texts, and rows without
doc_id, count as documents of their own, ordered by (doc_id, digest of the text), null last.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.tables import documents, written
from pathweave.llm.text import SPACED, Block, blocks, find_words, window_hashes

WINDOW, ANCHOR = 20, 6
#: Occurrences of one anchor that a task takes at once: some 5 MB of words, 20 MB as sorted rows.
GROUP = 32_768

NO_WORDS = hashlib.sha256(b"").hexdigest()


def anchors(block: Block, window: int = WINDOW, anchor: int = ANCHOR):
    """Words of the block, and per window of a document: (first word, position and hash of its anchor)."""
    words = find_words(block, SPACED)
    span = window - anchor + 1
    hashes = np.full(len(words.hashes), ~np.uint64(0))
    at, own = window_hashes(words, anchor)
    hashes[at] = own
    # least hash of each span of positions, the leftmost of equals, by doubling
    best, where, have = hashes, np.arange(len(hashes)), 1
    while have < span:
        step = min(have, span - have)
        n = max(0, len(best) - step)
        right = best[step:] < best[:n]
        best, where, have = np.where(right, best[step:], best[:n]), np.where(right, where[step:], where[:n]), have + step
    last = np.repeat(words.first[1:], np.diff(words.first))
    start = np.flatnonzero(np.arange(len(best)) + window <= last[: len(best)])
    return words, start, where[start], best[start]


def summaries(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, digest, n_words, sha256 of all words joined by single spaces, hashes of the anchors at each of their positions."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                words, start, where, hashes = anchors(block, window, anchor)
                new = np.flatnonzero(np.diff(where, prepend=-1))
                owner = np.searchsorted(words.first, start[new], "right") - 1
                cuts = np.searchsorted(owner, np.arange(block.n + 1))
                out = []
                for i in range(block.n):
                    text = block.text(i)
                    out.append((hashlib.md5(text, usedforsecurity=False).digest(), int(words.first[i + 1] - words.first[i]),
                                hashlib.sha256(b" ".join(text.split())).hexdigest(), hashes[new[cuts[i] : cuts[i + 1]]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(block.first, block.n), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.string()),
                    pa.array([o[3] for o in out], pa.list_(pa.int64()))], ["doc_id", "digest", "n_words", "whole", "anchors"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n_words long, whole string, anchors array<long>")


def occurrences(candidates: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per occurrence of a repeated anchor: the windows it stands for, and the words they cover, joined by single spaces.

    ``doc``: key of the candidate; ``first``: first window; ``n``: number of windows.
    """
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            listed = batch.column(2)
            for block in blocks(batch.column(1)):
                words, start, where, hashes = anchors(block, window, anchor)
                begin = np.flatnonzero(np.diff(where, prepend=-1))
                end = np.append(begin[1:], len(where))
                owner = np.searchsorted(words.first, start[begin], "right") - 1
                cuts = np.searchsorted(owner, np.arange(block.n + 1))
                rows = []
                for i in range(block.n):
                    known = set(listed[block.first + i].as_py())
                    tokens = block.text(i).split()
                    base = words.first[i]
                    for k in range(cuts[i], cuts[i + 1]):
                        key = int(hashes[begin[k]].view(np.int64))
                        if key in known:
                            a, n = int(start[begin[k]] - base), int(end[k] - begin[k])
                            rows.append((key, keys[block.first + i], a, n, b" ".join(tokens[a : a + n - 1 + window])))
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "doc", "first", "n", "words"])

    return candidates.select("doc", "text", "listed").mapInArrow(run, "anchor long, doc binary, first long, n long, words binary")


def subtree(doc: np.ndarray, first: np.ndarray, n: np.ndarray, words: list[bytes], group: np.ndarray, window: int) -> np.ndarray:
    """Flags per window (occurrences one after another, n each): whether it occurs earlier in its group.

    Windows are the suffixes down to depth ``window``, as rows of word numbers behind their group; sorted, equal
    neighbours hang from one internal node of that depth.
    """
    tokens = [w.split() for w in words]
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(t, len(number)) for ts in tokens for t in ts], np.int32)
    begin = np.cumsum([0, *(len(t) for t in tokens)])[:-1]
    which = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    rows = np.empty((len(which), window + 1), np.int32)
    rows[:, 0] = np.unique(group, return_inverse=True)[1][which]
    rows[:, 1:] = flat[(begin[which] + offset)[:, None] + np.arange(window)]
    place = np.lexsort((first[which] + offset, np.unique(doc, return_inverse=True)[1][which]))  # document order
    order = place[np.argsort(rows[place].view(f"V{4 * (window + 1)}").ravel(), kind="stable")]
    same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    flags = np.zeros(len(which), bool)
    flags[order[1:][same]] = True
    return flags


def repeats_in_groups(found: DataFrame, window: int) -> DataFrame:
    """Repeated windows of the groups that a task can hold: doc, first and bits (one per window from first on)."""
    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = table.column("anchor").to_numpy()
            cut = int(np.argmax(keys == keys[-1])) if len(keys) else 0  # the last group may go on
            held = table.slice(cut).combine_chunks()
            if cut:
                yield from solve(table.slice(0, cut))
        if held is not None and held.num_rows:
            yield from solve(held)

    def solve(table):
        first, n, group = (table.column(c).to_numpy() for c in ("first", "n", "anchor"))
        doc = np.array(table.column("doc").to_pylist(), dtype="S24")
        flags = subtree(doc, first, n, table.column("words").to_pylist(), group, window)
        bits = np.bitwise_or.reduceat(flags.astype(np.int64) << (np.arange(len(flags)) - np.repeat(np.cumsum(n) - n, n)), np.cumsum(n) - n)
        keep = bits != 0
        yield pa.RecordBatch.from_arrays([table.column("doc").combine_chunks().filter(pa.array(keep)), pa.array(first[keep]), pa.array(bits[keep])], ["doc", "first", "bits"])

    return (found.select("anchor", "doc", "first", "n", "words").repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(run, "doc binary, first long, bits long"))


def repeats_of_hot(found: DataFrame, window: int) -> DataFrame:
    """The same for groups beyond GROUP. Occurrences with the same words are met by their digest: all but the first repeat it
    as a whole. Of the firsts, each window is a group of its own, with the earliest start as a combined minimum."""
    found = written(found.select("doc", "first", "n", "words").withColumn("same", F.unhex(F.md5("words"))), "hot")
    firsts = written(found.groupBy("same").agg(F.min(F.struct("doc", "first")).alias("e"), F.first("words").alias("words"), F.first("n").alias("n")), "firsts")
    is_first = F.struct("doc", "first") == F.col("e")
    later = found.select("same", "doc", "first", "n").join(firsts.select("same", "e"), "same").filter(~is_first)
    later = later.select("doc", "first", F.expr("shiftleft(1L, int(n)) - 1").alias("bits"))

    def run(batches):
        for batch in batches:
            rows = []
            for e, n, words in zip(*(batch.column(c).to_pylist() for c in range(3))):
                tokens = words.split()
                rows += [(hashlib.md5(b" ".join(tokens[k : k + window]), usedforsecurity=False).digest(), e["doc"], e["first"] + k) for k in range(n)]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()))], ["key", "doc", "first"])

    windows = written(firsts.select("e", "n", "words").mapInArrow(run, "key binary, doc binary, first long"), "windows")
    earliest = windows.groupBy("key").agg(F.min(F.struct("doc", "first")).alias("e"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    earliest = earliest.select(F.concat("key", F.lit(b"")).alias("key"), "e")  # a key of its own, see remove_repeats
    return later.union(windows.join(earliest, "key").filter(~is_first).select("doc", "first", F.lit(1).cast("long").alias("bits")))


def covered(candidates: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    """Per candidate: n_removed, kept_sha256 and the kept text."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                out = []
                for text, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tokens = (text or "").encode().split()
                    change = np.zeros(len(tokens) + 1, np.int64)
                    for mark in marks:
                        bits, at = mark["bits"], mark["first"]
                        while bits:
                            low = (bits & -bits).bit_length() - 1
                            change[at + low] += 1
                            change[at + low + window] -= 1
                            bits &= bits - 1
                    keep = np.cumsum(change[:-1]) == 0
                    kept = b" ".join(compress(tokens, keep))
                    out.append((len(tokens) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
                columns = list(zip(*out)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string())))],
                                                 ["doc", "n_removed", "kept_sha256", "kept"])

    marks = repeats.groupBy("doc").agg(F.collect_list(F.struct("first", "bits")).alias("marks"))  # at most one per word of the document
    return candidates.select("doc", "text").join(marks, "doc").select("doc", "text", "marks").mapInArrow(
        run, "doc binary, n_removed long, kept_sha256 string, kept string")


def ordered_key(doc_id: Column, digest: Column) -> Column:
    """Sixteen hexadecimal digits that sort like doc_id (null last), then some of the digest, as bytes."""
    low = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.encode(F.concat(F.coalesce(low, F.lit("G" * 16)), F.left(F.hex(digest), F.lit(8))), "US-ASCII")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256; ``kept`` (text) where some but not all words went."""
    if not 0 < window - anchor < 62:
        raise ValueError("anchors must be shorter than windows, by at most 61 words")
    docs = documents(docs)
    known = written(summaries(docs, window, anchor), "summaries")
    reps = known.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    own = F.col("doc_id").eqNullSafe(F.col("rep"))
    doc = ordered_key(F.col("doc_id"), F.col("digest")).alias("doc")
    suffixes = (known.filter(F.size("anchors") > 0).select("doc_id", "digest", "anchors").join(reps, "digest").filter(own)
                .select(doc, F.explode("anchors").alias("anchor")))
    shared = suffixes.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor", (F.col("c") > group).alias("hot"))
    # the rows per anchor may be many: with a key of its own the join has exchanges on both sides, whose hot keys Spark can split
    shared = shared.withColumn("anchor", F.col("anchor").bitwiseXOR(F.lit(0).cast("long")))
    listed = suffixes.join(shared, "anchor").groupBy("doc").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    texts = docs.select(ordered_key(F.col("doc_id"), digest).alias("doc"), "text")
    candidates = written(texts.join(listed, "doc").dropDuplicates(["doc"]), "candidates")
    cold = candidates.filter(F.size("cold") > 0).withColumn("listed", F.col("cold"))
    repeats = repeats_in_groups(occurrences(cold, window, anchor), window)
    hot = candidates.filter(F.size("hot") > 0).withColumn("listed", F.col("hot"))
    if not hot.isEmpty():
        repeats = repeats.union(repeats_of_hot(occurrences(hot, window, anchor), window))
    changed = covered(candidates, repeats, window)
    rows = known.select("doc_id", "digest", "n_words", "whole").join(reps, "digest").withColumn("doc", ordered_key(F.col("doc_id"), F.col("digest")))
    rows = rows.join(changed, "doc", "left")
    copy = ~own & (F.col("n_words") >= window)
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, NO_WORDS).when(own, F.coalesce("kept_sha256", "whole")).otherwise(F.col("whole")).alias("kept_sha256"),
        F.when(own, F.col("kept")).alias("kept"))
