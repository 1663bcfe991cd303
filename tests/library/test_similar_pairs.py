"""Pairs of like token sets against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import matching


@pytest.mark.parametrize("block", [7, 4_096])
def test_similar_pairs_are_those_of_a_brute_force(spark, block):
    rng = random.Random(block)
    rows, base = [], []
    for i in range(240):
        n = rng.choice([1, 2, 3, 10, 30, 31, 64, 150, 400])
        if base and rng.random() < 0.7:  # a copy with some words changed
            words, change = list(rng.choice(base)), rng.choice([0, 0.02, 0.1, 0.2])
            words = [w if rng.random() > change else f"x{rng.randrange(900)}" for w in words][: rng.choice([len(words), max(1, len(words) * 2 // 3)])]
        else:
            words = [f"w{rng.randrange(900)}" for _ in range(n)]
        base.append(words)
        rows.append((i, f"d{i % 9}" if i % 50 else None, i % 3 if i % 41 else None, " ".join(words) if i % 47 else None))
    df = spark.createDataFrame(rows, "id long, document_id string, owner long, text string")
    got = {(r.a, r.b): (r.shared, r.score) for r in matching.similar_pairs(df, 0.8, F.filter(F.split("text", " "), lambda w: w != ""), block=block).collect()}
    want, sets = {}, {i: set((t or "").split()) for i, _, _, t in rows}
    for i, d, o, _ in rows:
        for j, e, p, _ in rows[i + 1 :]:
            if o is not None and o == p and d and e and d != e and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                score = round(n / (len(sets[i]) * len(sets[j])) ** 0.5, 6)
                if n >= 2 and score >= 0.8:
                    want[i, j] = (n, score)
    assert got == want and len(want) > 20


def test_many_texts_leave_few_pairs_to_compare(spark):
    """Texts of common words share tokens pairwise; only those alike meet with their tokens."""
    rng = random.Random(1)
    rows = [(i, f"d{i}", 0, " ".join(rng.sample([f"w{k}" for k in range(400)], 100))) for i in range(400)]
    rows.append((400, "copy", 0, rows[7][3]))
    df = spark.createDataFrame(rows, "id long, document_id string, owner long, text string")
    found = matching.similar_pairs(df, 0.8, F.split("text", " "))
    assert [(r.a, r.b, r.shared) for r in found.collect()] == [(7, 400, 100)]
