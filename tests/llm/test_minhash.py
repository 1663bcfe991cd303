from __future__ import annotations

import hashlib

import numpy as np

from sparkloom.llm import minhash
from sparkloom.llm.queries import op4_fingerprints, table


def expected(rows):
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = {}
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        out[i] = (text, edited, following)
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want, got = expected(rows), op4_fingerprints(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        text, edited, following = want[r.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = minhash.sketch(text), minhash.sketch(edited)
        assert (r.fingerprint, r.edited_fingerprint) == (minhash.spelled(a), minhash.spelled(b))
        assert r.near_edited == minhash.likeness(a, b) and r.near_next == minhash.likeness(a, minhash.sketch(following))


def jaccard(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(4)
    errors = []
    for n in (40, 200, 800):
        for share in (0.2, 0.5, 0.9):
            for _ in range(12):
                words = [f"w{v}" for v in rng.integers(0, 10**9, n)]
                other = words[: int(n * share)] + [f"w{v}" for v in rng.integers(0, 10**9, n - int(n * share))]
                a, b = " ".join(words), " ".join(other)
                errors.append(minhash.likeness(minhash.sketch(a), minhash.sketch(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_edges(documents):
    rows = [(1, None), (2, "x"), (3, ""), (4, "é" * 7), (5, "a b c d e f " * 20000)]
    got = {r.doc_id: r for r in minhash.edited_pairs(documents(rows)).collect()}
    for i, (text, edited, _) in expected(rows).items():
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[1].fingerprint == got[3].fingerprint and got[1].near_edited == 1.0


def test_repeats_nulls_and_empty_table(documents):
    got = minhash.edited_pairs(documents([(7, "a b c"), (7, "a b c"), (None, "z")])).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got if r.doc_id == 7}) == 1
    one = minhash.edited_pairs(documents([(7, "a b c d e f")])).collect()[0]
    assert one.near_next == 1.0
    assert minhash.edited_pairs(documents([])).collect() == []
