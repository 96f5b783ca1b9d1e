"""Secret scan: fixed patterns, and strings that a tokenizer finds hard to write.

Base spans are an assignment of a value to a secret's name, an access key id, and long hexadecimal runs. The method adds
spans of kind ``random``: runs of 20 or more characters of the value alphabet which mix at least two of lower case, upper
case and digits and need many tokens for their length (characters per token below ``ratio`` under a public vocabulary).
Known digests (hexadecimal runs of the usual digest lengths) and identifiers (UUIDs, dates and numbers, dotted or
slashed names of plain words) are excluded from the method; base spans always stay. A random run isn't reported again where base
spans together cover all of it but plain words; if anything else lies outside them, the whole run is reported.

Defined results: null counts as empty; offsets are code points, end exclusive; a text of any length is scanned whole.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.tables import with_results
from pathweave.llm.text import Block, blocks, byte_class

#: The kinds in their order, and the patterns of the contract (on UTF-8: all their characters are ASCII).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 8, 16, 32, 20
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
PLAIN = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*|[0-9]*")

FIELDS = T.StructType([
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("redacted", T.StringType())])

_HEX = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66)
_VALUE = byte_class(lambda b: chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_.=-"))


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def runs(block: Block, keep: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of maximal runs within documents that have at least ``least`` bytes."""
    inside = np.zeros(len(block.data) + 1, np.int8)
    inside[:-1] = keep[block.data]
    cuts = np.concatenate([np.flatnonzero(np.diff(inside, prepend=np.int8(0))), block.offsets])
    cuts = np.unique(cuts)
    starts, ends = cuts[:-1], cuts[1:]
    long = (ends - starts >= least) & (inside[starts] > 0)
    return starts[long], ends[long]


def excluded(run: str) -> bool:
    """Known digests and identifiers."""
    core = run.strip("+/_.=-")
    if re.fullmatch(r"[0-9a-fA-F]+", core) and (len(core) in DIGEST_LENGTHS or core.isdigit()):
        return True
    if UUID.fullmatch(core) or plain(run):
        return True
    return sum(any(map(kind, run)) for kind in (str.islower, str.isupper, str.isdigit)) < 2


def scan_block(block: Block, tokens, ratio: float) -> list[list[tuple[str, int, int]]]:
    """Spans of each document in bytes, as (kind, start, end)."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(block.n)]

    def own(starts):
        return np.searchsorted(block.offsets, starts, "right") - 1

    for kind, keep, least in (("hex", _HEX, MIN_HEX), ("random", _VALUE, MIN_RANDOM)):
        starts, ends = runs(block, keep, least)
        for i, a, b in zip(own(starts), starts.tolist(), ends.tolist()):
            if kind == "random":
                run = block.data[a:b].tobytes().decode()
                if excluded(run) or len(run) >= ratio * len(tokens.encode_ordinary(run)):
                    continue
            found[i].append((kind, a - int(block.offsets[i]), b - int(block.offsets[i])))
    whole = block.data.tobytes()
    lowered = whole.lower()
    wanted = {int(own(m.start())) for name in NAMES for m in re.finditer(re.escape(name), lowered)}
    for i in wanted:
        for m in ASSIGN.finditer(block.text(i)):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found[i].append(("assign", m.start(), m.end()))
    for i in {int(own(m.start())) for m in re.finditer(rb"AKIA", whole)}:
        for m in ACCESS.finditer(block.text(i).decode("latin-1")):
            if m.end() - m.start() >= MIN_ACCESS:
                found[i].append(("access", m.start(), m.end()))
    return found


def plain(text: str) -> bool:
    """Words, numbers and punctuation only."""
    return all(PLAIN.fullmatch(part) for part in re.split(r"[+/_.=-]+", text))


def kept_spans(found: list[tuple[str, int, int]], text: bytes) -> list[tuple[str, int, int]]:
    """Spans by start, then kind, without random runs of which base spans leave nothing, or only plain words."""
    base: list[list[int]] = []
    for a, b in sorted(s[1:] for s in found if s[0] != "random"):
        if base and a <= base[-1][1]:
            base[-1][1] = max(base[-1][1], b)
        else:
            base.append([a, b])
    ends = [b for _, b in base]

    def reported(a, b):
        k = bisect_right(ends, a)
        while k < len(base) and base[k][0] < b:
            if not plain(text[a : max(a, base[k][0])].decode()):
                return False
            a, k = base[k][1], k + 1
        return a >= b or (k > 0 and a == base[k - 1][1] and plain(text[a:b].decode()))

    return sorted((s for s in found if s[0] != "random" or not reported(*s[1:])), key=lambda s: (s[1], KINDS.index(s[0])))


def in_points(spans: list[tuple[str, int, int]], text: bytes) -> list[dict]:
    """Byte offsets as offsets of code points."""
    at, points = 0, {0: 0}
    for b in sorted({x for s in spans for x in s[1:]}):
        points[b] = points[at] + len(text[at:b].decode())
        at = b
    return [{"kind": kind, "start": points[a], "end": points[b]} for kind, a, b in spans]


def without(text: bytes, found: list[tuple[str, int, int]], mark: str) -> str:
    """The text with ``mark`` for each span; spans that overlap or touch become one."""
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda s: s[1]):
        if a >= at and (a > at or not out):
            out += [text[at:a].decode(), mark]
        at = max(at, b)
    return "".join([*out, text[at:].decode()])


def with_secrets(df: DataFrame, path: str, pattern: str, ratio: float = 2.0, mark: str | None = None, column: str = "secrets") -> DataFrame:
    """Add a struct: ``spans`` lists (kind, start, end) by start, then kind; ``redacted`` is the text with ``mark``
    for each span, or null without a mark or a span. ``path``: rank file of the vocabulary."""

    def start():
        tokens = encoding(path, pattern)

        def compute(texts):
            spans, redacted = [], []
            for block in blocks(texts):
                for i, found in enumerate(scan_block(block, tokens, ratio)):
                    kept = kept_spans(found, block.text(i))
                    spans.append(in_points(kept, block.text(i)) if kept else [])
                    redacted.append(without(block.text(i), kept, mark) if kept and mark is not None else None)
            return [pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(redacted, pa.string())]

        return compute

    return with_results(df, column, FIELDS, start)


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def report(docs: DataFrame, path: str, pattern: str, ratio: float = 2.0) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    spans = F.col("secrets.spans")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter(spans, lambda s: s.kind != "random"))
    return with_secrets(docs.select("doc_id", "text"), path, pattern, ratio).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(df: DataFrame, path: str, pattern: str, ratio: float = 2.0, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mark``. Texts without a span, null ones too, stay as they are."""
    out = with_secrets(df, path, pattern, ratio, mark, "__secrets")
    return out.withColumn("text", F.coalesce("__secrets.redacted", "text")).drop("__secrets")
