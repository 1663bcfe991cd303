"""Intervals, gates and splits against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluation, gates, resampling, splits
from sparkloom.operators.resampling import Draws, Metric, seed_of
from sparkloom.plans import gates as queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", [0, 1, 7, 2**40 + 5, seed_of(7, "a", "b")])
def test_draws_are_pythons(seed):
    for n, size in ((1, 5), (2, 100), (3, 1), (1000, 5000), (1024, 70), (2**31 - 1, 10)):
        rng = random.Random(seed)
        assert Draws(seed).below(n, size).tolist() == [rng.randrange(n) for _ in range(size)]
    rng, mine = random.Random(seed), Draws(seed)
    for n in (5, 9, 1, 77, 5):
        assert mine.below(n, 40).tolist() == [rng.randrange(n) for _ in range(40)]


def plain_quantile(values, q):
    ordered = sorted(values)
    at = (len(ordered) - 1) * q
    low = math.floor(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)


def plain_clusters(rows, samples, seed, level=0.95):
    """(n, clusters, baseline, candidate, low, high) of (cluster, baseline, candidate)."""
    of = defaultdict(list)
    for c, x, y in rows:
        of[c].append(y - x)
    table = [(math.fsum(v), len(v)) for _, v in sorted(of.items())]
    low = high = None
    if len(table) > 1:
        rng, drawn = random.Random(seed), []
        for _ in range(samples):
            picked = [table[rng.randrange(len(table))] for _ in table]
            drawn.append(sum(s for s, _ in picked) / sum(n for _, n in picked))
        low, high = plain_quantile(drawn, (1 - level) / 2), plain_quantile(drawn, (1 + level) / 2)
    return len(rows), len(table), sum(r[1] for r in rows) / len(rows), sum(r[2] for r in rows) / len(rows), low, high


def near(a, b):
    return a is b is None or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_cluster_intervals_draw_for_draw(spark, monkeypatch):
    monkeypatch.setattr(resampling, "DRAWS", 700)  # several tasks a key
    got = {(r.key, r.metric): r for r in queries.sta1_drawn(spark, SF).collect()}
    rows = queries.paired(spark, SF).collect()
    assert {k for k, _ in got} == {r.pool for r in rows} and len(got) == 2 * len({r.pool for r in rows})
    for (pool, metric), r in got.items():
        b, c = ("baseline", "candidate") if metric == "recall_at_10" else ("b_ndcg", "c_ndcg")
        mine = [(str(x.cluster_id), float(x[b]), float(x[c])) for x in rows if x.pool == pool and x[b] is not None and x[c] is not None]
        want = plain_clusters(mine, 1000, seed_of(7, pool, metric))
        assert all(near(a, x) for a, x in zip((r.n, r.clusters, r.baseline, r.candidate, r.low, r.high), want))


def test_one_cluster_has_no_interval_and_many_use_weights(spark):
    rows = [("a", "c", 0.1, 0.2)] * 3 + [("b", f"c{i}", 0.0, float(i % 2)) for i in range(300)] + [("b", "n", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, c string, x double, y double")
    got = {r.key: r for r in resampling.cluster_intervals(df, "k", "c", [Metric("m", "x", "y")], 200, 1).collect()}
    assert got["a"].low is None and got["a"].clusters == 1 and got["b"].clusters == 300
    exact = got["b"]
    other = {r.key: r for r in resampling.cluster_intervals(df, "k", "c", [Metric("m", "x", "y")], 200, 1, units=10).collect()}["b"]
    assert abs(other.low - exact.low) < 0.03 and abs(other.high - exact.high) < 0.03 and other.improvement == exact.improvement


def test_stratified_intervals(spark):
    rows = sorted(queries.paired(spark, SF).collect(), key=lambda r: r.case_id)
    for r in queries.sta2_drawn(spark, SF).collect():
        m = next(m for m in (queries.RECALL, queries.NDCG, queries.LATENCY, queries.NUMBERS) if m.name == r.metric)
        mine = [x for x in rows if x[m.baseline] is not None and x[m.candidate] is not None]
        strata = defaultdict(list)
        for i, x in enumerate(mine):
            strata[x.stratum].append(i)
        rng = random.Random(seed_of(7, m.name))

        def value(col, of, at):
            v = [float(mine[i][col]) for i in at]
            if m.statistic == "p95":
                return sorted(v)[max(0, math.ceil(0.95 * len(v)) - 1)]
            if m.statistic == "ratio":
                total = sum(mine[i][of] for i in at)
                return sum(v) / total if total else 0.0
            return sum(v) / len(v)

        sign, deltas = (1 if m.better == "higher" else -1), []
        for _ in range(200):
            at = [g[rng.randrange(len(g))] for g in strata.values() for _ in range(len(g))]
            deltas.append(sign * (value(m.candidate, m.candidate_of, at) - value(m.baseline, m.baseline_of, at)))
        deltas.sort()
        assert near(r.low, deltas[math.floor(199 * 0.05 / 4)]) and near(r.high, deltas[math.floor(199 * (1 - 0.05 / 4))]) and near(r.target_low, deltas[math.floor(199 * 0.05)])
        whole = range(len(mine))
        assert r.n == len(mine) and near(r.improvement, sign * (value(m.candidate, m.candidate_of, whole) - value(m.baseline, m.baseline_of, whole)))


def test_more_cases_than_units_are_drawn_in_parts(spark):
    """The same values and, within the spread of 200 samples, the same ends as of single cases."""
    metrics = [queries.RECALL, queries.NDCG, queries.LATENCY, queries.NUMBERS]
    rows = queries.paired(spark, SF)
    want = {r.metric: r for r in resampling.stratified_intervals(rows, "case_id", "stratum", metrics, 400, 7).collect()}
    got = {r.metric: r for r in resampling.stratified_intervals(rows, "case_id", "stratum", metrics, 400, 7, units=10, part=20).collect()}
    assert set(got) == set(want) == {m.name for m in metrics}
    for m, r in got.items():
        w = want[m]
        assert r.n == w.n and near(r.baseline, w.baseline) and near(r.candidate, w.candidate) and near(r.improvement, w.improvement)
        assert abs(r.low - w.low) < 0.3 * (w.high - w.low) and abs(r.high - w.high) < 0.3 * (w.high - w.low) and r.low <= r.target_low <= r.high


def test_hash_goes_on_over_numbers(spark):
    df = spark.range(200).select(F.xxhash64(F.lit(7), F.col("id").cast("string")).alias("h"), *(F.xxhash64(F.lit(7), F.col("id").cast("string"), F.lit(j)).alias(f"h{j}") for j in (1, 2, 500))).toPandas()
    for j in (1, 2, 500):
        assert (evaluation.next_hash(df["h"].to_numpy().view(np.uint64), j).view(np.int64) == df[f"h{j}"].to_numpy()).all()


def test_hierarchical_intervals(spark):
    of = defaultdict(list)
    for r in queries.paired(spark, SF).collect():
        if r.baseline is not None:
            of[r.language, r.cluster_id].append((float(r.baseline), float(r.candidate)))
    for r in queries.sta3_drawn(spark, SF).collect():
        mine = [(str(u % 50), np.mean([x for x, _ in v]), np.mean([y for _, y in v])) for (lang, u), v in of.items() if lang == r.key]
        want = plain_clusters(mine, 1000, seed_of(7, r.key, "recall_at_10"))
        assert all(near(a, b) for a, b in zip((r.n, r.clusters, r.baseline, r.candidate, r.low, r.high), want))


def test_retrieval_gate_rules(spark):
    policy = queries.retrieval_policy(100)
    rows = {(r.kind, r.slice_id, r.metric): r for r in gates.retrieval_decisions(queries.paired(spark, SF), policy).collect()}
    assert len(rows) == 2 * (1 + 3 + 3 + 5) + 1
    assert rows["scope", "s9", "ndcg_at_10"].codes == ["slice_insufficient:scope:s9:ndcg_at_10"] and not rows["scope", "s9", "ndcg_at_10"].passed
    for (kind, _, metric), r in rows.items():
        if r.low is None:
            continue
        margin = 0.01 if kind in ("global", "no_answer") else 0.02
        target = 0.02 if kind == "global" and metric == "ndcg_at_10" else None
        assert r.passed == (r.low >= -margin and (target is None or r.low >= target)) and r.passed == (r.codes == [])


def load_row(spark, **changes):
    row = {"b_concurrency": 10, "b_requests": 200, "b_errors": 0, "b_p95": 1000.0, "b_throughput": 10.0, "c_concurrency": 10, "c_requests": 200, "c_errors": 0, "c_p95": 1100.0, "c_throughput": 9.0} | changes
    return spark.createDataFrame([tuple(row.values())], list(row))


def operations_row(spark, **changes):
    names = ("update_visibility", "delete_visibility", "restart_recovery", "rollback")
    row = {f"{n}_ok": True for n in names} | {f"{n}_seconds": 60.0 for n in names} | {"b_leaks": 0, "c_leaks": 0, "replays": 3, "mismatches": 0, "replay_seconds": 1.0, "rollback_manifest": "a", "baseline_manifest": "a"} | changes
    return spark.createDataFrame([tuple(row.values())], list(row))


def test_load_and_operation_rules(spark):
    policy = queries.retrieval_policy()
    load = lambda **x: gates.load_codes(load_row(spark, **x), policy).first().codes
    assert load() == []
    assert load(c_errors=1) == load(b_requests=199) == load(c_concurrency=9) == ["load_integrity"]
    assert load(c_p95=1100.1) == ["latency_p95"] and load(b_p95=10_000.0, c_p95=10_251.0) == ["latency_p95"] and load(c_throughput=8.9) == ["throughput"]
    done = lambda **x: gates.operation_codes(operations_row(spark, **x), policy).first().codes
    assert done() == [] and done(b_leaks=1) == ["rls_leak:baseline"] and done(c_leaks=2) == ["rls_leak:candidate"]
    assert done(rollback_ok=False) == done(rollback_seconds=60.5) == ["rollback"] and done(update_visibility_ok=False) == ["update_visibility"]
    assert done(replays=2) == done(mismatches=1) == done(replay_seconds=61.0) == ["determinism"] and done(rollback_manifest="b") == ["rollback_binding"]


def test_release_gate(spark):
    policy = queries.release_policy()
    rows = {r.metric: r for r in queries.gat2_metrics(spark, SF).collect()}
    for m in policy.metrics:
        r = rows[m.metric.name]
        margin = min(m.margin, abs(r.baseline) * m.relative_margin) if m.relative_margin else m.margin
        want = [] if r.low >= -margin else [f"noninferiority:{r.metric}"]
        want += [f"bound:{r.metric}"] if m.maximum is not None and r.candidate > m.maximum else []
        if r.metric == policy.target:
            want += [f"practical_gain:{r.metric}"] if r.improvement < m.practical else []
            want += [f"statistical_gain:{r.metric}"] if r.target_low <= 0 else []
        assert near(r.margin, margin) and sorted(r.codes) == sorted(want) and r.passed == (not want)
    whole = queries.gat2_decision(spark, SF).first()
    assert set(c for r in rows.values() for c in r.codes) <= set(whole.failure_codes) and whole.accepted == (not whole.failure_codes)


def plain_split(of, labels, seed, fraction, exhaustive=18):
    """Whole search over lists of clusters."""
    names = sorted(of)
    total = sum(len(v) for v in of.values())
    wanted = max(1, min(round(total * fraction), total - 1))
    have = {n: {x for c in of[n] for x in labels[c]} for n in names}
    shares = {x: sum(x in have[n] for n in names) for x in {x for v in have.values() for x in v}}
    if len(names) <= exhaustive:
        tries = [s for k in range(1, len(names)) for s in itertools.combinations(names, k)]
        tie = lambda s: hashlib.sha256(f"{seed}:{','.join(sorted(s))}".encode()).hexdigest()
    else:
        order = sorted(names, key=lambda n: hashlib.sha256(f"{seed}:{n}".encode()).hexdigest())
        tries = [tuple(order[:k]) for k in range(1, len(order))]
        tie = lambda s: hashlib.sha256(f"{seed}:{s[-1]}".encode()).hexdigest()
    best = None
    for s in tries:
        here = {x: sum(x in have[n] for n in s) for x in shares}
        if any(n > 1 and not 0 < here[x] < n for x, n in shares.items()):
            continue
        error = round(sum(abs(here[x] / len(s) - n / len(names)) for x, n in shares.items()), 9)
        score = (abs(sum(len(of[n]) for n in s) - wanted), error, tie(s))
        if best is None or score < best[0]:
            best = (score, s)
    return set(best[1])


@pytest.mark.parametrize("clusters, seed", [(7, 1), (9, 2), (40, 3)])
def test_split_equals_a_plain_search(spark, clusters, seed):
    rng = random.Random(seed)
    of, cases, labels = {}, [], {}
    for _ in range(clusters):
        mine = [f"c{len(labels) + i:03}" for i in range(rng.randrange(1, 7))]
        for c in mine:
            labels[c] = set(rng.sample("abcd", rng.randrange(1, 3)))
            cases += [(c, f"d{mine[0]}"), (c, f"own{c}")]
        of[mine[0]] = mine
    df, marks = spark.createDataFrame(cases, "case string, document string"), spark.createDataFrame([(c, x) for c, v in labels.items() for x in v], "case string, label string")
    got = splits.cluster_split(df, marks, seed, 0.4).collect()
    locked = plain_split(of, labels, seed, 0.4)
    assert {(r.case, r.part) for r in got} == {(c, "locked" if n in locked else "tuning") for n, v in of.items() for c in v}


def test_split_refuses(spark):
    one = spark.createDataFrame([("a", "d"), ("b", "d")], "case string, document string")
    marks = spark.createDataFrame([("a", "x")], "case string, label string")
    with pytest.raises(ValueError):
        splits.cluster_split(one, marks, 1, 0.5)
    with pytest.raises(ValueError):
        splits.cluster_split(one, marks, 1, 1.0)
