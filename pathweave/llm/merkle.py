"""Merkle manifest of a table: one root, and for every row a witness that it belongs to the root.

A row is a leaf: H of its fields, each ``-`` if null, else UTF-8 byte count, ``:`` and value. H is SHA-256 in lowercase hex, of its inputs
one after the other. Leaves of a group ascend by the order column; every two consecutive nodes become their H, a last single one
becomes the H of itself, until one node is left, the group's subroot. Subroots in the order of their groups give the root likewise.

Witnesses grow by streaming aligned appends. Leaves are numbered within their group and cut into aligned blocks of 2^BITS. A task
reads a block in order and keeps a stack of complete subtrees; when two of one height meet, the members of each get the other's
digest as their next sibling. A closed block has a root, and block roots are appended to a tree of the same kind, as often as it takes; the
siblings found there extend the witnesses of all members of the block. So no task holds more than one block, whatever a group's size.

Defined results: a null group is one group and the first; rows of equal order value stand by leaf; repeated rows are leaves of their
own; null order values come first and are never tampered with; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.llm.tables import ROWS, small_batches, written

BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Before any position of a block: the row that brings what the block's members share.
SHARED = -1
LEFT, RIGHT, ALONE = "L", "R", "-"


def h(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


class OpenTree:
    """Leaves appended one by one; ``siblings[i, level]`` is the witness of leaf i so far (empty: none, or not yet known)."""

    def __init__(self, bits: int, witnesses: bool = True):
        self.stack: list[tuple[int, int, bytes]] = []  # height, first leaf, digest
        self.n = 0
        self.siblings = np.zeros((1 << bits, bits), "S64") if witnesses else None

    def append(self, leaf: bytes) -> None:
        self.stack.append((0, self.n, leaf))
        self.n += 1
        self.meet()

    def meet(self) -> None:
        """Subtrees of one height beside each other become one, and extend the witnesses of their members."""
        while len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            level, middle, right = self.stack.pop()
            _, first, left = self.stack.pop()
            if self.siblings is not None:
                self.siblings[first:middle, level] = right
                self.siblings[middle : self.n, level] = left
            self.stack.append((level + 1, first, h(left, right)))

    def close(self, height: int | None) -> tuple[bytes, int]:
        """The root and its height: ``height`` where the tree goes on above it, else where one node is left."""
        while len(self.stack) > 1 or (height is not None and self.stack[-1][0] < height):
            level, first, digest = self.stack.pop()
            self.stack.append((level + 1, first, h(digest)))
            self.meet()
        return self.stack[0][2], self.stack[0][0]


def fold(leaf: bytes, path: Sequence[str]) -> bytes:
    """The root that a leaf and its siblings (L or R and the digest; - for none) lead to."""
    for step in path:
        sibling = step[1:].encode()
        leaf = h(leaf) if step == ALONE else h(sibling, leaf) if step[0] == LEFT else h(leaf, sibling)
    return leaf


def proof(path: Sequence[str]) -> str:
    """H of the siblings, from the leaf up."""
    return h(*(step[1:].encode() for step in path if step != ALONE)).decode()


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit(ALONE)).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def tampered(order: Column) -> Column:
    """The rows that the check of the manifest tampers with."""
    return F.coalesce(F.crc32(order.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", count: str = "n_chars") -> DataFrame:
    """g (the group, ordered as text), id, leaf, changed (the leaf with 1 added to ``count``, where tampered with), seq."""
    own = [F.col(f) for f in fields]
    more = [F.col(f).cast("decimal(20,0)") + 1 if f == count else F.col(f) for f in fields]
    # the sign before a group's name puts null before the empty name
    return docs.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(order).alias("id"), leaf(own).alias("leaf"),
                       F.when(tampered(F.col(order)), leaf(more)).alias("changed"), F.monotonically_increasing_id().alias("seq"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos (from 0, within g) and n (rows of g): ranges are sorted and counted, so that no task sees a whole group."""
    by = ["g", *order]
    ranged = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(
        {"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "merkle-order")
    w = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("part", "g").agg(F.count(F.lit(1)).alias("k"), F.min("row").alias("first"))
    counts = counts.withColumns({"before": F.coalesce(F.sum("k").over(w), F.lit(0)), "n": F.sum("k").over(W.partitionBy("g"))})
    return ranged.join(counts.drop("k"), ["part", "g"]).withColumn("pos", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "before", "first")


def in_blocks(nodes: DataFrame, bits: int, *columns: str) -> DataFrame:
    """g, block, at (place in the block), tall (whether the group goes on above its blocks) and further columns."""
    return nodes.select("g", F.shiftright("pos", bits).alias("block"), F.col("pos").bitwiseAND((1 << bits) - 1).cast("int").alias("at"),
                        (F.col("n") > 1 << bits).alias("tall"), *columns)


def streamed(blocks: DataFrame, run, schema: str) -> DataFrame:
    small_batches(blocks.sparkSession)
    return blocks.repartition("g", "block").sortWithinPartitions("g", "block", "at").mapInArrow(run, schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def block_roots(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """g, pos (the block), n (blocks of the group), digest."""

    def run(batches):
        made, tree = [], None
        for g, block, at, tall, digest in rows_of(batches):
            if at == 0:
                if tree:
                    made.append((*key, tree.close(height)[0]))
                tree, key, height = OpenTree(bits, witnesses=False), (g, block), bits if tall else None
            tree.append(digest.hex().encode())
            if len(made) >= ROWS:
                yield batch(made)
                made = []
        yield batch([*made, (*key, tree.close(height)[0])] if tree else [])

    def batch(made):
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()),
                                           pa.array([bytes.fromhex(m[2].decode()) for m in made], pa.binary())], ["g", "pos", "digest"])

    roots = streamed(in_blocks(nodes, bits, "digest"), run, "g string, pos bigint, digest binary")
    sizes = nodes.groupBy("g").agg(F.max("n").alias("n"))
    return roots.join(sizes, "g").select("g", "pos", F.ceil(F.col("n") / F.lit(1 << bits)).cast("long").alias("n"), "digest")


PATHS = pa.schema([("g", pa.string()), ("id", pa.int64()), ("digest", pa.binary()), ("path", pa.list_(pa.string()))])
PROOFS = pa.schema([("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])
DDL = {PATHS: "g string, id bigint, digest binary, path array<string>",
       PROOFS: "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"}


def witnessed(nodes: DataFrame, shared: DataFrame, schema: pa.Schema, bits: int = BITS) -> DataFrame:
    """Every node (g, pos, n, id, digest, changed) with its witness up to the end of its block's ``path``.

    ``shared`` holds g, pos (the block), path, subroot, root: one row per block, which reaches the task ahead of the block. PATHS
    gives the whole path of each node; PROOFS the digest of the path, and the root that the changed (else own) leaf leads to.
    """

    def run(batches):
        made, tree = [], None
        for g, block, at, tall, own, digest, changed, path, subroot, root in rows_of(batches):
            if at == SHARED:
                if tree:
                    made += finished(tree, *key)
                tree, key = OpenTree(bits), ([], path, subroot, root)
                continue
            if at == 0:
                key = (*key, g, bits if tall else None)
            tree.append(digest.hex().encode())
            key[0].append((own, digest, changed))
            if len(made) >= ROWS:
                yield batch(made)
                made = []
        yield batch([*made, *(finished(tree, *key) if tree else ())])

    def finished(tree, members, above, subroot, root, g, height):
        _, height = tree.close(height)
        for i, (own, digest, changed) in enumerate(members):
            path = [(LEFT if i >> level & 1 else RIGHT) + s.decode() if s else ALONE for level, s in enumerate(tree.siblings[i, :height].tolist())] + above
            if schema is PATHS:
                yield g, own, digest, path
            else:
                start = digest if changed is None else changed
                yield own, digest.hex(), subroot.hex(), root.hex(), proof(path), fold(start.hex().encode(), path).decode()

    def batch(made):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * len(schema), schema.types)], schema.names)

    none = F.lit(None)
    rows = in_blocks(nodes, bits, F.col("id").cast("long").alias("id"), "digest", "changed").withColumns(
        {"path": none.cast("array<string>"), "subroot": none.cast("binary"), "root": none.cast("binary")})
    ahead = shared.select("g", F.col("pos").alias("block"), F.lit(SHARED).alias("at"), F.lit(False).alias("tall"), none.cast("long").alias("id"),
                          none.cast("binary").alias("digest"), none.cast("binary").alias("changed"), "path", "subroot", "root")
    return streamed(rows.unionByName(ahead), run, DDL[schema])


def climb(nodes: DataFrame, most: int, bits: int = BITS) -> DataFrame:
    """g, pos, digest and path (to the root of g) of each node (g, pos, n, digest), whose groups hold ``most`` nodes at most; and the subroot of g."""
    if most <= 1:
        return nodes.select("g", "pos", "digest", F.array().cast("array<string>").alias("path"), F.col("digest").alias("subroot"))
    above = climb(written(block_roots(nodes, bits), "merkle-roots"), -(-most >> bits), bits)
    subroots = above.filter("pos = 0").select("g", "subroot")
    own = nodes.select("g", "pos", "n", F.col("pos").alias("id"), "digest", F.lit(None).cast("binary").alias("changed"))
    paths = witnessed(own, above.withColumn("root", F.col("subroot")), PATHS, bits)
    return written(paths.join(subroots, "g").select("g", F.col("id").alias("pos"), "digest", "path", "subroot"), "merkle-paths")


def manifest(docs: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame] | None:
    """The numbered leaves, and per block of them what its members share: g, pos, path (from the block to the root), subroot, root."""
    nodes = numbered(written(leaves(docs), "merkle-leaves"), ["id", "leaf", "seq"]).withColumnRenamed("leaf", "digest")
    most = nodes.agg(F.max("n")).first()[0]
    if most is None:
        return None
    blocks = climb(written(block_roots(nodes, bits), "merkle-roots"), -(-most >> bits), bits)
    groups = blocks.filter("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("digest"))
    groups = numbered(groups, ["name"])
    top = climb(written(groups, "merkle-groups"), groups.count(), bits).select("pos", F.col("path").alias("rest"), F.col("subroot").alias("root"))
    top = groups.select("pos", F.col("name").alias("g")).join(top, "pos").select("g", "rest", "root")
    return nodes, written(blocks.join(top, "g").select("g", "pos", F.concat("path", "rest").alias("path"), "subroot", "root"), "merkle-shared")


def witnesses(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, leaf and path (siblings from the leaf to the root, with their sides) of every row."""
    made = manifest(docs, bits)
    if made is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, path array<string>")
    return witnessed(*made, PATHS, bits).select(F.col("id").alias("doc_id"), F.lower(F.hex("digest")).alias("leaf"), "path")


def verify(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    made = manifest(docs, bits)
    if made is None:
        out = docs.sparkSession.createDataFrame([], DDL[PROOFS])
    else:
        out = witnessed(*made, PROOFS, bits)
    return out.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))
