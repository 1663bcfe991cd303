"""Quality classifier, language ID and the pipeline: held-out accuracy and defined cases."""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import language, quality
from sparkloom.llm.queries import op9_quality, op10_language, table, tokenizer

SF = "/root/testdata/sf0.1"


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in op9_quality(spark, SF).collect()}
    labels = table(spark, SF, "labels").collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_prior_estimate():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(0, 1, (4000, 5)), rng.normal(3, 1, (1000, 5))
    unlabelled = np.vstack([rng.normal(0, 1, (4000, 5)), neg])[rng.permutation(5000)]
    assert abs(quality.class_prior(pos, unlabelled) - 0.8) < 0.05
    net = quality.train(pos, unlabelled, 0.8, rounds=300)
    p = quality.sigmoid(net.odds(net.normed(np.vstack([pos[:500], neg[:500]]))))
    assert (p[:500] >= 0.3).mean() > 0.97 and (p[500:] < 0.3).mean() > 0.95


def test_quality_edges(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (2, 0, 0), (77, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a fine text, with words."), (2, None), (3, ""), (4, "x " * 100_000), (4, "x"), (None, "no id")])
    got = quality.scored(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and not next(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(documents([]), labels).collect() == []
    assert quality.without_rejected(docs, labels).columns == docs.columns


def test_language_held_out(spark):
    docs = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    rows = op10_language(spark, SF).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in rows if r.held_out]) > 0.99


def test_forward_sums_all_segmentations():
    vocab = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aba"])}
    p = np.append(np.linspace(0.05, 0.3, len(vocab)), 1e-7)
    lattice = language.Lattice(["abab", "b", "xa"], vocab, language.prefixes(vocab))
    for word, got in zip(["abab", "b", "xa"], lattice.log_total(p)):
        w, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:])]
            total += math.prod(p[vocab[s]] if s in vocab else 1e-7 if len(s) == 1 else 0.0 for s in parts)
        assert abs(got - math.log(total)) < 1e-9
    counts = lattice.expected(p, np.ones(3))
    lengths = np.array([len(k) for k in vocab] + [1])
    assert abs((counts * lengths).sum() - sum(len(w) + 1 for w in ["abab", "b", "xa"])) < 1e-6  # every letter lies in one piece


def test_language_edges(documents):
    rows = [(i, t) for i, t in enumerate(["the cat and the dog", "the house is here", "and this one"] * 5)] + [(90, None), (91, ""), (92, "123 !?"), (93, "日本語 текст"), (94, "a" * 5000), (94, "the"), (None, "the end")]
    got = language.identified(documents(rows), tokenizer("piece_bpe_32k.model")).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows) and by[90] == by[91] == by[92] == ("und", 0.0) and by[93][0] == by[None][0] == "en"
    assert language.identified(documents([]), tokenizer("piece_bpe_32k.model")).collect() == []


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's output at sf0.01."""
    sf = "/root/testdata/sf0.01"
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        out.append((name, docs))
    return out


def test_pipeline_stages(spark, stages):
    first = table(spark, "/root/testdata/sf0.01", "documents")
    assert [n for n, _ in stages] == ["quality classifier", "simhash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    ids = [{r.doc_id for r in df.select("doc_id").distinct().collect()} for _, df in stages]
    assert all(df.columns == first.columns for _, df in stages[:-1])
    assert ids[0] < {r.doc_id for r in first.select("doc_id").collect()} and ids[1] < ids[0] and ids[2] == ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    bad = {r.doc_id for r in table(spark, "/root/testdata/sf0.01", "labels").where("quality = 0").collect()}
    assert len(bad & ids[0]) <= 0.1 * len(bad)
    texts = [r.text for r in stages[1][1].select("text").collect()]
    assert len(texts) == len(set(texts))


def test_risk_against_a_plain_loop():
    """The non-negative risk by its definition, its gradient by differences, on either side of zero."""
    rng = np.random.default_rng(12)
    for prior, shift in ((0.3, 0.0), (0.7, 0.5), (0.9, -3.0), (0.9, 2.0)):
        op, ou = rng.normal(1 + shift, 1, 30), rng.normal(-shift, 1, 50)

        def parts(op, ou):
            loss = lambda z: math.log1p(math.exp(-z))
            return prior * sum(loss(z) for z in op) / len(op), sum(loss(-z) for z in ou) / len(ou) - prior * sum(loss(-z) for z in op) / len(op)

        positive, negative, g = quality.risk(op, ou, prior)
        want = parts(op, ou)
        assert abs(positive - want[0]) < 1e-12 and abs(negative - want[1]) < 1e-12
        target = (lambda p, u: sum(parts(p, u))) if negative >= 0 else (lambda p, u: -parts(p, u)[1])
        for k in (0, 7, 30, 61):
            z, step = np.concatenate([op, ou]), np.zeros(80)
            step[k] = 1e-5
            slope = (target((z + step)[:30], (z + step)[30:]) - target((z - step)[:30], (z - step)[30:])) / 2e-5
            assert abs(slope - g[k]) < 1e-7


def test_language_fit_uses_all_words(spark, monkeypatch):
    """Expectation maximisation over tasks equals one lattice over all words; every word counts, however rare."""
    vocab = {p: i for i, p in enumerate(sorted(["▁", *"abcdefgh", "ab", "▁a", "cd", "▁ef", "gh"]))}
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcdefgh"), rng.integers(1, 7))) for _ in range(400)})
    weights = rng.integers(1, 9, len(words)).astype(float)
    counted = spark.createDataFrame([(0, w, int(n)) for w, n in zip(words, weights)] + [(1, "ab", 1)], "lang int, word string, count long").repartition(5)
    model = language.fit(["x", "y"], counted, vocab, rounds=2)
    p, lattice = language.begin(len(vocab)), language.Lattice(words, vocab, language.prefixes(vocab))
    for _ in range(2):
        seen = lattice.expected(p, weights)[:-1] + 0.1
        p = np.append(seen / seen.sum(), language.UNKNOWN)
    assert np.allclose(model.p[0], p)


def test_many_languages(documents):
    from pyspark.sql import functions as F

    rows = [(i, f"word{chr(97 + i % 26)} {chr(97 + i % 26) * 3} text") for i in range(300)]
    docs = documents(rows).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 26).cast("string")))
    got = language.identified(docs, tokenizer("piece_bpe_32k.model")).collect()
    assert len(got) == 300 and np.mean([r.lang_pred == f"l{r.doc_id % 26}" for r in got]) > 0.9


def test_pipeline_on_empty_and_null_rows(spark, tmp_path):
    """All five stages over empty tables, and over rows with nulls in every column, repeated ids and extra columns."""
    from pyspark.sql import functions as F

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels, bench = (table(spark, "/root/testdata/sf0.001", t) for t in ("labels", "benchmark"))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "no id but words " * 20, "en", None, 5), (1, "again " * 30, None, "s", None), (1, "again " * 30, None, "s", None), (2, "", "en", "s", 0)], docs.schema)
    for name, d, few in (("empty", docs.limit(0), True), ("nulls", odd.unionByName(docs), False)):
        d.withColumn("words", F.lit("w")).withColumn("node", F.lit(1)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels.limit(0) if few else labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        (bench.limit(0) if few else bench).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert few == (not got)
