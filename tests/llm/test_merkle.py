import zlib
from hashlib import sha256

import pytest

from pathweave.llm import merkle, queries


def sha(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(row):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
            i >>= 1
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([*map(leaf, members)]) for g, members in groups.items()}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            siblings = path(trees[g], i) + path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1 if hit and r[3] is not None else r[3], r[4]))
            for right, s in siblings:
                now = sha(now) if s is None else sha(s, now) if right else sha(now, s)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, sha(*(s for _, s in siblings if s)), now, now == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = got(queries.op12_merkle(spark, sf_dir))
    assert out == brute(rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert {r[-1] for r in out} == {True, False} and len({r[3] for r in out}) == 1


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_small_blocks_are_further_appends(spark, sf_dir, bits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(90)
    assert got(merkle.verify(docs, bits)) == brute(rows_of(docs))


def test_witnesses_lead_to_the_root(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    roots = {merkle.fold(r.leaf.encode(), r.path).decode() for r in merkle.witnesses(docs, 3).collect()}
    assert roots == {merkle.verify(docs).first().root}


def test_odd_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, g string, pos int, leaf int, path string"
    plain = [(i, f"s{i}", ["en", "", None, "é", "zz"][i % 5], None if i % 4 == 0 else i, ["", None, "text " * 5000, "ü🤖"][i % 4]) for i in range(40)]
    plain += [(7, "s7", "en", 7, "again"), (7, "s7", "en", 7, "again"), (None, "x", "en", 9, "no id"), (None, None, None, None, None), (2**62, "a", "en", 2**63 - 1, "b")]
    docs = spark.createDataFrame([(*r, "c", 1, 2, "d") for r in plain], schema)
    for bits in (2, merkle.BITS):
        assert got(merkle.verify(docs, bits)) == brute(plain)
    one = docs.filter("doc_id = 3")
    assert got(merkle.verify(one)) == brute(plain[3:4])
    assert got(merkle.verify(docs.limit(0))) == [] and merkle.witnesses(docs.limit(0)).count() == 0
