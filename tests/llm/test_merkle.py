"""The Merkle manifest against a tree built in one list, and against its own proofs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loadcast.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = [doc_id, source, lang, n_chars, text]
    return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes, fanout):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([digest(*row[i : i + fanout]) for i in range(0, len(row), fanout)])
    return levels


def path(levels, place, fanout):
    out = []
    for row in levels[:-1]:
        start = place - place % fanout
        out.append((row[start:place], row[place + 1 : start + fanout]))
        place //= fanout
    return out


def plain(rows, fanout, tampered):
    leaves = {}
    for row in rows:
        leaves.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), tampered(row)))
    order = sorted(leaves, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: tree([x[2] for x in sorted(leaves[lang], key=lambda x: (x[:3], x[3] or ""))], fanout) for lang in order}
    top = tree([trees[lang][-1][0] for lang in order], fanout)
    out = []
    for at, lang in enumerate(order):
        for place, (known, doc_id, leaf, other) in enumerate(sorted(leaves[lang], key=lambda x: (x[:3], x[3] or ""))):
            proof = path(trees[lang], place, fanout) + path(top, at, fanout)
            node = other or leaf
            for left, right in proof:
                node = digest(*left, node, *right)
            out.append((doc_id if known else None, lang, place, leaf, trees[lang][-1][0], top[-1][0], proof, node))
    return out


def tampered(row):
    doc_id, text, lang, source, n_chars = row
    hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
    return leaf_of(doc_id, text, lang, source, None if n_chars is None else n_chars + 1) if hit else None


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def check(spark, rows, fanout=2, height=2):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(docs, merkle.tampering(), fanout, height)
    got = got.withColumn("folded", merkle.fold(F.coalesce("replacement", "leaf"), F.col("proof"))).collect()
    mine = []
    for r in got:
        assert r.folded == r.folded_root and r.verified == (r.folded_root == r.root)
        proof = [(list(x.left), list(x.right)) for x in r.proof]
        mine.append((r.doc_id, r.lang, r.position, r.leaf, r.subroot, r.root, proof, r.folded_root))
    assert sorted(mine, key=str) == sorted(plain(rows, fanout, tampered), key=str)
    return got


@pytest.mark.parametrize("fanout, height", [(2, 1), (2, 3), (3, 2), (2, 12)])
def test_trees(spark, fanout, height):
    rows = [(i * 3 % 101, f"text {i}", "en", "web", i) for i in range(101)]
    rows += [(200 + i, "x", lang, None, 1) for lang, n in (("de", 2), ("fr", 1), ("é", 5), (None, 9), ("", 3)) for i in range(n)]
    got = check(spark, rows, fanout, height)
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_edges(spark):
    rows = [
        (1, None, None, None, None),
        (1, "", None, "", 0),
        (None, "a", "en", "s", 1),
        (None, "a", "en", "s", 1),
        (7, "é𝄞" * 50_000, "en", "s", 2**63 - 1),
        (7, "same", "en", "s", 3),
        (7, "same", "en", "s", 3),
        (-5, "minus", "=", "-", -1),
    ]
    rows += [(n, "big", "en", "s", 2**63 - 1) for n in range(10, 30)]
    check(spark, rows)
    check(spark, [(3, "only", "en", "s", 1)])
    assert merkle.manifest_report(spark.createDataFrame([], SCHEMA)).count() == 0
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as tree", "1 as node", "2 as position", "3 as size", "4 as replacement", "5 as chunk")
    assert merkle.manifest_report(more).count() == len(rows)


def test_proof_digest(spark):
    rows = [(i, f"text {i}", ("en", "de")[i % 2], "web", i) for i in range(11)]
    got = {r.doc_id: r for r in merkle.manifest_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc_id, _, _, leaf, _, root, proof, folded in plain(rows, 2, tampered):
        want = digest(*[x for left, right in proof for x in (*left, *right)])
        assert (got[doc_id].proof_sha256, got[doc_id].leaf, got[doc_id].root, got[doc_id].folded_root) == (want, leaf, root, folded)
