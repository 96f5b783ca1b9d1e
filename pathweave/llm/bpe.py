"""Byte-level BPE: encode by speculation and verification, and decode.

A word (what the pre-tokenizer splits off) is first cut greedily into its longest vocabulary entries. A row of tokens is
what the merge rules give exactly when each token is reachable by merging and each adjacent pair is compatible, that is,
when merging the bytes of the two gives the same two tokens. All adjacent pairs of all proposed words are tested at once by
walking back through the merges that made the two. Only words with an incompatible pair go through the merge rules
themselves, many words a round.

Defined results: null encodes like an empty text (no tokens); the text of a special token becomes its single id, as in
the tokenizer file; repeated rows get equal answers; a text of any length is encoded whole, words of any length in
O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.tables import with_results

#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words that a worker remembers, and their mean length at most. When full, the most used half stays; results don't depend on it.
REMEMBERED, CHARS = 100_000, 32
#: Longest word in bytes that is handled as a row of a matrix; longer ones are cut and merged one by one.
SHORT = 64
NONE = np.int32(np.iinfo(np.int32).max)

FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
DECODED = T.StructType([T.StructField("text", T.StringType())])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file, with the words that were met most."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size = max(self.tokens) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = as_bytes(a), as_bytes(b)
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(PATTERN)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.index_merges()
        self.index_prefixes()
        self.reached = np.full(self.size, -1, np.int8)
        self.remember([*self.special], [[i] for i in self.special.values()])

    def index_merges(self) -> None:
        """Merges as sorted arrays, and for each token the halves and the rank it is made of."""
        pairs = sorted((a * self.size + b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair, self.rank = np.array([p for p, _, _ in pairs], np.int64), np.array([r for _, r, _ in pairs], np.int32)
        self.made = np.full(self.size, -1, np.int32)
        self.left, self.right = np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
        self.result = np.zeros(max(self.rank, default=-1) + 1, np.int32)
        self.ordered = True
        for (a, b), (rank, new) in self.merges.items():
            # trained vocabularies make each token by one merge, after both of its halves
            self.ordered &= self.made[new] < 0 and max(self.made[a], self.made[b]) < rank
            self.made[new], self.left[new], self.right[new], self.result[rank] = rank, a, b, new

    def index_prefixes(self) -> None:
        """The prefix tree of all tokens: sorted keys (node * 256 + byte), the node behind each, and the token of a node."""
        children: dict[int, int] = {}
        token = [-1]
        for word, i in self.ids.items():
            node = 0
            for b in word:
                node = children.setdefault(node << 8 | b, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        self.edge = np.array(sorted(children), np.int64)
        self.child = np.array([children[k] for k in self.edge.tolist()], np.int32)
        self.token_at = np.array(token, np.int32)
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)

    def remember(self, words: list[str], ids: list) -> None:
        """Start the memory with these words."""
        self.words = {w: k for k, w in enumerate(words)}
        self.flat = np.array([t for row in ids for t in row], np.uint32)
        self.begin = np.cumsum([0, *map(len, ids)])
        self.uses = np.zeros(len(words), np.int64)
        self.held = sum(map(len, words))

    def thin(self) -> None:
        """Keep the most used half of the memory (special tokens always), so that it stays bounded for ever."""
        words = [*self.words]
        rank = self.uses.copy()
        rank[: len(self.special)] = np.iinfo(np.int64).max
        keep, room = [], REMEMBERED * CHARS // 2
        for k in np.argsort(-rank, kind="stable")[: max(len(self.special), REMEMBERED // 2)].tolist():
            room -= len(words[k])
            if room >= 0 or k < len(self.special):
                keep.append(k)
        keep.sort()
        uses = self.uses[keep] // 2
        self.remember([words[k] for k in keep], [self.flat[self.begin[k] : self.begin[k + 1]] for k in keep])
        self.uses = uses

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; NONE where the two don't merge."""
        asked = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, asked), len(self.pair) - 1)
        return np.where((self.pair[at] == asked) & (left >= 0) & (right >= 0), self.rank[at], NONE) if len(self.pair) else np.full(len(asked), NONE)

    def merge(self, word: bytes) -> list[int]:
        """The merge rules: always the pair of lowest rank, the leftmost of equals."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(*self.merges[p], i, p) for i, p in ((i, (ids[i], ids[i + 1])) for i in range(len(ids) - 1)) if p in self.merges]
        heap = [(rank, i, p, new) for rank, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, p, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != p[0] or j < 0 or ids[j] != p[1]:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (pair := (ids[k], ids[after[k]])) in self.merges:
                    rank, made = self.merges[pair]
                    heapq.heappush(heap, (rank, k, pair, made))
        return [t for t in ids if t >= 0]

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """The merge rules for many words of at most SHORT bytes: each round merges one pair in every word that has one."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([*map(len, words)])
        below = 0
        for width in (8, 16, 32, SHORT):
            rows = np.flatnonzero((sizes > below) & (sizes <= width))
            below = width
            if not len(rows):
                continue
            ids = np.full((len(rows), width + 1), -1, np.int32)
            ids[np.arange(width + 1) < sizes[rows, None]] = self.byte_id[np.frombuffer(b"".join(words[i] for i in rows.tolist()), np.uint8)]
            ranks = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width)
            live, cols = np.arange(len(rows)), np.arange(width)
            while len(live):
                mine = ranks[live]
                k = mine.argmin(1)
                best = mine[np.arange(len(live)), k]
                go = best < NONE
                live, k, best, mine = live[go], k[go], best[go], mine[go]
                if not len(live):
                    break
                line = np.arange(len(live))
                moved = np.take_along_axis(ids[live], np.minimum(cols + (cols > k[:, None]), width), 1)
                moved[line, k] = self.result[best]
                ids[live, :width], ids[live, width] = moved, -1
                mine = np.take_along_axis(mine, np.minimum(cols + (cols > k[:, None]), width - 1), 1)
                mine[:, -1] = NONE
                mine[line, k] = self.ranks(ids[live, k], ids[live, k + 1])
                some = k > 0
                mine[line[some], k[some] - 1] = self.ranks(ids[live[some], k[some] - 1], ids[live[some], k[some]])
                ranks[live] = mine
            counts = (ids >= 0).sum(1)
            flat = ids[ids >= 0].tolist()
            ends = np.cumsum(counts).tolist()
            for i, end, n in zip(rows.tolist(), ends, counts.tolist()):
                out[i] = flat[end - n : end]
        return out

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """The merge rules for words of any length."""
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        out: list[list[int]] = [[]] * len(words)
        for k, ids in zip(short, self.merge_short([words[k] for k in short])):
            out[k] = ids
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = self.merge(w)
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy cut into longest entries."""
        out, i = [], 0
        while i < len(word):
            j = min(len(word), i + self.longest)
            while (t := self.ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy cuts of many words: all tokens in order, and how many each word has. Short words walk the prefix tree together."""
        sizes = np.array([*map(len, words)], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        owner, tokens = [], []
        for k in np.flatnonzero(sizes > SHORT).tolist():
            tokens.append(np.array(self.propose(words[k]), np.int32))
            owner.append(np.full(len(tokens[-1]), k))
        live = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
        at, node = (ends - sizes)[live], np.zeros(len(live), np.int64)
        best, best_end, end = np.full(len(live), -1, np.int32), at.copy(), ends[live]
        while len(live):
            asked = node << 8 | data[np.minimum(at, len(data) - 1)]
            k = np.minimum(np.searchsorted(self.edge, asked), len(self.edge) - 1)
            step = (self.edge[k] == asked) & (at < end)
            node, at = np.where(step, self.child[k], 0), at + step
            token = np.where(step, self.token_at[node], -1)
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, at, best_end)
            stuck = ~step
            owner.append(live[stuck])
            tokens.append(best[stuck])
            at = np.where(stuck, best_end, at)
            left = ~stuck | (at < end)
            live, at, node, best, best_end, end = live[left], at[left], node[left], np.where(stuck, -1, best)[left], best_end[left], end[left]
        owner, tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, tokens))
        return tokens[np.argsort(owner, kind="stable")].astype(np.int64), np.bincount(owner, minlength=len(words))

    def reachable(self, tokens: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a token gives that token."""
        new = np.unique(tokens[self.reached[tokens] < 0]).tolist()
        for t, ids in zip(new, self.merged([self.tokens[t] for t in new])):
            self.reached[t] = ids == [t]
        return self.reached[tokens] > 0

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of reachable tokens gives that pair again.

        Seen backwards in time, the two come apart merge by merge. The pieces that meet at the border must not have merged
        with each other while both were there: before the merge that took the left one away (at equal rank that merge is the more
        left one and goes first), and not after the merge that took the right one away.
        """
        if not self.ordered:
            return np.array([self.merge(self.tokens[a] + self.tokens[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist())], bool)
        fits = np.ones(len(left), bool)
        live, x, y = np.arange(len(left)), left, right
        taken_x, taken_y = np.full(len(left), NONE), np.full(len(left), NONE)
        while len(live):
            rank = self.ranks(x, y)
            crossed = (rank < taken_x) & (rank <= taken_y) & (rank < NONE)
            fits[live[crossed]] = False
            made_x, made_y = self.made[x], self.made[y]
            back_x = made_x > made_y
            taken_x, taken_y = np.where(back_x, made_x, taken_x), np.where(back_x, taken_y, made_y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
            more = ~crossed & (np.maximum(made_x, made_y) >= 0)
            live, x, y, taken_x, taken_y = live[more], x[more], y[more], taken_x[more], taken_y[more]
        return fits

    def learn(self, words: list[str]) -> None:
        """Tokens of words that have not been seen."""
        raw = [w.encode() for w in words]
        flat, lengths = self.propose_all(raw)
        owner = np.repeat(np.arange(len(words)), lengths)
        bad = np.zeros(len(words), np.bool_)
        bad[owner[~self.reachable(flat)]] = True
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        asked, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad[owner[inner[~self.compatible(asked // self.size, asked % self.size)[which]]]] = True
        again = np.flatnonzero(bad)
        exact = self.merged([raw[i] for i in again.tolist()])
        sizes = lengths.copy()
        sizes[again] = [*map(len, exact)]
        made = np.zeros(int(sizes.sum()), np.uint32)
        remade = np.repeat(bad, sizes)
        made[~remade] = flat[~bad[owner]]
        made[remade] = [t for ids in exact for t in ids]
        base = len(self.begin) - 1
        self.words.update(zip(words, range(base, base + len(words))))
        self.flat = np.concatenate([self.flat, made])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.held += sum(map(len, words))

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        return [w for k, part in enumerate(self.special_split.split(text)) for w in ([part] if k % 2 else self.split.findall(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.words) > REMEMBERED or self.held > REMEMBERED * CHARS:
            self.thin()
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(self.words)
        if new:
            self.learn(sorted(new))
        out = []
        for words in split:
            at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            self.uses[at] += 1
            begin = self.begin[at]
            size = self.begin[at + 1] - begin
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(total) + np.repeat(begin - ends + size, size)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def in_groups(texts: pa.Array, limit: int = 1 << 20):
    """Lists of whole texts of about ``limit`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        size += len(group[-1])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(df: DataFrame, path: str, column: str = "bpe", decoded: bool = False) -> DataFrame:
    """Add a struct with n_tokens and ids (little-endian unsigned 32-bit integers) of column ``text``; ``decoded`` adds what the ids
    say again, in the same worker."""

    def start():
        vocab = vocabulary(path)

        def compute(texts):
            ids = [i for group in in_groups(texts) for i in vocab.encode(group)]
            out = [pa.array([len(i) for i in ids], pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())]
            return [*out, pa.array(map(vocab.decode, ids), pa.string())] if decoded else out

        return compute

    return with_results(df, column, T.StructType([*FIELDS.fields, *DECODED.fields]) if decoded else FIELDS, start)


def decode(df: DataFrame, path: str, ids: str, column: str = "decoded") -> DataFrame:
    """Add a struct with the text of the binary column ``ids`` (null: empty); special tokens are kept."""

    def start():
        vocab = vocabulary(path)
        return lambda rows: [pa.array([vocab.decode(np.frombuffer(r.as_py() or b"", "<u4")) for r in rows], pa.string())]

    return with_results(df, column, DECODED, start, (ids,))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return hashed(encode(docs.select("doc_id", "text"), path, decoded=True), "doc_id")


def hashed(encoded: DataFrame, *columns: str) -> DataFrame:
    """``columns``, n_tokens, ids_sha256 and decoded_sha256 of rows that were encoded and decoded."""
    return encoded.select(*columns, "bpe.n_tokens", F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2(F.col("bpe.text").cast("binary"), 256).alias("decoded_sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
