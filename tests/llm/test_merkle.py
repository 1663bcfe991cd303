"""Merkle manifest: against a plain tree in Python, defined cases, and checks of stored proofs."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import merkle

DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain(rows):
    """Every document's digests by whole trees in memory."""
    of = {}
    for r in rows:
        of.setdefault(r[1], []).append(r)
    sources = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in of[s]]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(of[s]):
            sides = []
            for levels, at in ((trees[k], i), (top, k)):
                for nodes in levels[:-1]:
                    sides.append((nodes[at // 3 * 3 : at], nodes[at + 1 : at // 3 * 3 + 3]))
                    at //= 3
            altered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            end = leaf(r[:4] + (r[4].replace("\n", ""),) if altered else r)
            for a, b in sides:
                end = h(*a, end, *b)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*(x for a, b in sides for x in a + b)), end, end == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture
def rows():
    rng = random.Random(5)
    made = []
    for i in range(330):  # one source holds most rows; 12 others, one of them null and one empty
        source = "hot" if i % 3 else rng.choice([None, "", "a", "Ж", "z", *(f"s{k}" for k in range(7))])
        text = rng.choice([None, "", "one\ntwo", "no feed", "\n", f"row {i}\n"])
        made.append((rng.choice([None, i, i, i, 7]), source, rng.choice([None, "en", "ру"]), rng.choice([None, 3]), text))
    return made + [(1, "lone", "en", 1, "x")] + [(5, "hot", "en", 9, "same\nrow")] * 40


@pytest.mark.parametrize("span", [1, 2, 7])
def test_equals_plain_trees(spark, rows, span):
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 as idx", "2 as tree", "'p' as part", "3 as leaf").repartition(5)
    assert found(merkle.proofs(docs, span=span)) == plain(rows)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 9, 10])
def test_small_tables(spark, count):
    rows = [(i, "s", None, None, f"t{i}\n") for i in range(count)]
    assert found(merkle.proofs(spark.createDataFrame(rows, DOCUMENTS), span=1)) == plain(rows)


def test_missing_is_the_least_set():
    """Nodes asked for are those of touched runs that neither leaves nor derived nodes give; fewer give no root."""
    for n in (1, 2, 5, 9, 28, 100):
        for known in ([0], [n - 1], list(range(n)), list(range(0, n, 4)), list(range(n // 2))[:7] or [0]):
            asked = merkle.missing(np.array(known), n)
            assert len(asked) == len(set(asked))
            have = {(0, i) for i in known} | set(asked)
            size, level = n, 0
            covered = set(known)
            while size > 1:
                runs = {i // 3 for i in covered}
                for r in runs:
                    inside = [i for i in range(3 * r, min(3 * r + 3, size))]
                    assert all((level, i) in have or i in covered for i in inside)
                    assert not any((level, i) in asked and i in covered for i in inside)
                covered, size, level = runs, -(-size // 3), level + 1
            assert not any(i // 3**lv == j for lv, j in asked for i in known)  # never a node above the leaves


def test_stored_proofs_find_changes(spark, rows):
    rows = [(i, s, *rest) for i, (_, s, *rest) in enumerate(rows)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    stored = merkle.proofs(docs, with_proof=True, span=2).select("doc_id", "proof", "root")
    changed = [(i, s, lang, n, "changed" if i == 17 else t) for i, s, lang, n, t in rows if i != 30] + [(9999, "a", None, None, None)]
    got = {r.doc_id: r.verified for r in merkle.verified_against(spark.createDataFrame(changed, DOCUMENTS), stored).collect()}
    assert {i for i, ok in got.items() if not ok} == {17, 30, 9999} and len(got) == len(rows) + 1


def test_proofs_fold(spark, rows):
    for r in merkle.proofs(spark.createDataFrame(rows, DOCUMENTS), with_proof=True, span=1).collect():
        pairs = [(p.left.encode(), p.right.encode()) for p in r.proof]
        assert merkle.folded(r.leaf.encode(), pairs).decode() == r.root
        assert h("".join(p.left + p.right for p in r.proof)) == r.proof_sha256
