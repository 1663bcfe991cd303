"""Pruned sums against whole ones, and searches with phrases against a plain reader."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fulltext, lexical


@pytest.mark.parametrize("k", [1, 5, 40])
def test_pruned_sums_are_the_whole_ones(spark, k):
    rng = random.Random(k)
    parts = [(i, "the", rng.choice([0.01, 0.02, 0.05])) for i in range(2000)]
    parts += [(i, f"w{t}", rng.random() * 3) for t in range(30) for i in rng.sample(range(2000), rng.choice([3, 40, 300]))]
    terms = [(q, t) for q in range(12) for t in {"the", *(f"w{rng.randrange(30)}" for _ in range(5))}] + [(99, "the"), (98, "none")]
    a = spark.createDataFrame(parts, "id int, term string, part double")
    b = spark.createDataFrame(terms, "query_id int, term string")
    rows = lambda direct: sorted(map(tuple, lexical.best_sums(a, b, k, direct).collect()))
    assert rows(0) == rows(10**9) and {r[0] for r in rows(0)} == {*range(12), 99}


def test_pruning_leaves_common_terms_out(spark, monkeypatch):
    """A term of every document meets a few candidates a query, not all documents."""
    seen = []
    kept = lexical.kept
    monkeypatch.setattr(lexical, "kept", lambda df: seen.append(kept(df)) or seen[-1])
    parts = spark.range(5000).selectExpr("id", "'the' as term", "0.01 as part").unionByName(spark.range(5000).where("id % 50 = 0").selectExpr("id", "'rare' as term", "1.0 + id / 1e6 as part"))
    terms = spark.createDataFrame([(q, t) for q in range(30) for t in ("the", "rare")], "query_id int, term string")
    assert lexical.best_sums(parts.selectExpr("id", "term", "cast(part as double) as part"), terms, 10, 0).count() == 300
    partial = next(df for df in seen if df.columns == ["query_id", "id", "s"])
    assert partial.count() == 30 * 100  # of 30 * 5100 rows


@pytest.mark.parametrize("k", [2, 30])
def test_best_documents_keep_a_row_a_document(spark, monkeypatch, k):
    """No posting is kept, whatever is asked; the rows are those of pruned postings, copies by id and texts without a word left out."""
    seen = []
    for name in ("kept", "measured"):
        keep = getattr(lexical, name, None)
        monkeypatch.setattr(lexical, name, lambda df, keep=keep: seen.append(keep(df)) or seen[-1], raising=False)
    monkeypatch.setattr(lexical, "SCORES", 50, raising=False)
    rng = random.Random(k)
    texts = [" ".join(rng.choice(["the", "pump", "oil", "seal", "of", "gear", "насос", "x1"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts + texts[:50]), (500, None), (501, "")], "id int, text string")
    asked = spark.createDataFrame([("a", "the pump of OIL"), ("b", "Насос, насос x1"), ("c", "none"), ("d", ""), ("e", None), ("f", "gear the seal pump oil of")], "q string, said string")
    find = lambda df: sorted(map(tuple, lexical.bm25(df, asked, "id", "text", "q", "said", k).collect()))
    got = find(docs)
    assert {r[0] for r in got} == {"a", "b", "f"} and max(df.count() for df in seen) <= 202
    assert got == [(q, int(i), *r) for q, i, *r in find(docs.withColumn("id", F.format_string("%03d", "id")))]
    assert lexical.bm25(docs, asked.where("q = 'd'"), "id", "text", "q", "said", k).count() == 0 == lexical.bm25(docs.limit(0), asked, "id", "text", "q", "said", k).count()


def test_texts_go_to_tasks_as_strings(spark, monkeypatch):
    """No array of words is made of a text; the words are those of ``tokens`` whatever stands between them."""
    counts = lexical._term_counts

    def checked(terms):
        def run(batches):
            for batch in batches:
                assert not str(batch.schema.field("w").type).startswith("list"), "an array of words"
                yield from counts(terms)(iter([batch]))

        return run

    monkeypatch.setattr(lexical, "_term_counts", checked)
    texts = ["  Pump\t\n oil.", "İzmir_pump-OIL", "насос\u00a0Straße e\u0301te", "٣ pump𝒳 ½ oil", "...", "", None, "pump", "oil\x00oil\u3000pump 東京"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q int, said string")
    find = lambda df: sorted((q, int(i), *r) for q, i, *r in map(tuple, lexical.bm25(df, asked, "id", "text", "q", "said", 20).collect()))
    assert find(docs) == find(docs.withColumn("id", F.format_string("%03d", "id"))) and {r[0] for r in find(docs)} == {0, 1, 2, 3, 7, 8}
    words = docs.select(lexical.tokens(F.col("text")).alias("a"), lexical.spaced(F.col("text")).alias("b")).collect()
    assert all(r.b == " ".join(r.a) for r in words)


def test_documents_without_an_id_count_but_are_not_found(spark):
    docs = spark.createDataFrame([(1, "pump oil"), (None, "pump"), (2, "gear")], "id int, text string")
    asked = spark.createDataFrame([(7, "pump"), (None, "gear")], "q int, said string")
    got = {(r.query_id, r.id): r.score for r in lexical.bm25(docs, asked, "id", "text", "q", "said", 5).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda df, n: round(idf(df) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / (4 / 3))), 6)
    assert got == {(7, 1): part(2, 2), (None, 2): part(1, 1)}


def plain(query, docs, ending):
    """Alternatives of (negated, words) by reading the query from left to right."""
    import re

    stem = lambda w: re.sub(ending, "", w) if len(w) >= 5 else w
    words = lambda t: [stem(w) for w in re.findall(r"[^\W_]+", t.lower())]
    alternatives = [[]]
    for said in re.findall(r'-?"[^"]*"|[^\s"]+', query):
        if said.lower() == "or":
            alternatives.append([])
        elif words(said):
            alternatives[-1].append((said.startswith("-"), words(said)))
    out = set()
    for i, text in docs.items():
        have = words(text)
        holds = lambda w: any(have[j : j + len(w)] == w for j in range(len(have)))
        if any(a and all(holds(w) != negated for negated, w in a) for a in alternatives):
            out.add(i)
    return out


QUERIES = ['alpha "beta gamma"', 'alpha or "gamma beta" -delta', '-alpha', '"alpha alpha"', "ALPHAS", 'or', '', 'nowhere -alpha', '"beta gamma" -"gamma delta" or epsilon', 'насосы', "а или б", '"unclosed beta']


def test_searches_equal_a_plain_reader(spark):
    rng = random.Random(4)
    docs = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Alphas", "epsilon,", "насос", "насосов"]) for _ in range(rng.randrange(9))) for i in range(150)}
    frame = spark.createDataFrame([*docs.items(), (500, None)], "id int, text string")
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "q int, said string")
    got = fulltext.matches(frame, asked, "id", "text", "q", "said", 1000).collect()
    docs[500] = ""
    for n, query in enumerate(QUERIES):
        want = set().union(*(plain(query, docs, e) for e in fulltext.ENDINGS.values()))
        mine = [r for r in got if r.query_id == n]
        assert {r.id for r in mine} == want, query
        assert [r.id for r in sorted(mine, key=lambda r: r["rank"])] == [r.id for r in sorted(mine, key=lambda r: (-r.score, r.id))]


def test_scores_count_phrases(spark):
    frame = spark.createDataFrame([(1, "a b a b"), (2, "a b"), (3, "b a")], "id int, text string")
    got = {r.id: r.score for r in fulltext.matches(frame, spark.createDataFrame([(1, '"a b"')], "q int, said string"), "id", "text", "q", "said", 9).collect()}
    want = frame.select(F.round(F.log1p(F.lit(2)), 6), F.round(F.log1p(F.lit(1)), 6)).first()
    assert got == {1: want[0], 2: want[1]}


def test_searches_keep_no_postings(spark, monkeypatch):
    """What is kept grows with the queries, not with the documents that hold their words; many units take a shuffle and give the same rows."""
    seen = []
    kept = fulltext.kept
    monkeypatch.setattr(fulltext, "kept", lambda df: seen.append(kept(df)) or seen[-1])
    frame = spark.range(3000).selectExpr("id", "concat(if(id % 500 = 0, 'alpha beta', 'beta alpha'), ' gamma delta') as text")
    asked = spark.createDataFrame([(1, '"alpha beta" gamma'), (2, "delta gamma"), (3, "-beta or missing"), (4, '"beta gamma" -delta')], "q int, said string")
    find = lambda: sorted(map(tuple, fulltext.matches(frame, asked, "id", "text", "q", "said", 5).collect()))
    got = find()
    assert [r[:3] for r in got] == [*((1, 500 * i, i + 1) for i in range(5)), *((2, i, i + 1) for i in range(5))]
    assert max(df.count() for df in seen) < 100
    monkeypatch.setattr(fulltext, "BROADCAST_UNITS", 0)
    assert find() == got


def test_match_all_equals_a_plain_search(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["the", "pump", "oil", "seal", "of", "gear"]) for _ in range(rng.randrange(9)))) for i in range(80)]
    asked = [(1, "the pump"), (2, "Oil oil of seal"), (3, "the unknown"), (4, ""), (5, "gear")]
    got = {}
    for r in lexical.match_all(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(asked, "q int, said string"), "id", "text", "q", "said", 7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    for q, said in asked:
        words = set(said.lower().split())
        hits = [(-round(sum(math.log1p(t.split().count(w)) for w in words), 6), i) for i, t in docs if words and words <= set(t.split())]
        assert got.get(q, {}) == {n: (i, -s) for n, (s, i) in enumerate(sorted(hits)[:7], 1)}
