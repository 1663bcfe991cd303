"""Answers less rejected claims, shadow decisions, answer checks: against plain versions and by single faults."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest

from sparkloom.functions import claims
from sparkloom.operators import decisions

NAMES = ("recall_at_5", "ndcg_at_10", "evidence_coverage", "page_coverage", "recall_at_10")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_answers_keep_all_but_the_rejected_claims(spark):
    text = "# Итог\nFirst  claim [1].  Second one!\n\n\n\nThird; третий。 第四 [2]。\nSources: \n1. Sources"
    df = spark.createDataFrame([(1, text), (2, "Only."), (3, None), (4, " a. b "), (5, "")], "id long, answer string")
    rejected = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (1, 4), (2, 0), (3, 0), (4, 9)], "id long, n int")
    out = {r.id: r.answer for r in claims.filtered_answers(df, "id", "answer", rejected).collect()}
    raw = [(m.start(), m.end()) for m in re.finditer(r"[^\n.!?。！？;；]+(?:[.!?。！？;；]+|(?=\n)|$)", text)]
    plain = text
    for n in (4, 2):  # the heading, 0, is no claim
        plain = plain[: raw[n][0]] + plain[raw[n][1] :]
    plain = re.sub(r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n", re.sub(r"[ \t]{2,}", " ", plain)).strip()
    assert out == {1: plain, 2: "", 3: None, 4: "a. b", 5: ""}


def plainly(cases: list[dict], policy: decisions.ShadowPolicy) -> dict:
    def means(rows):
        return {f"{s}_{m}": sum(r[f"{s}_{m}"] for r in rows) / len(rows) for s in "bc" for m in NAMES}

    groups: dict = {}
    for r in cases:
        groups.setdefault(("answerable" if r["answerable"] else "no_answer_probe",), []).append(r)
        if r["answerable"]:
            for place in {("language", r["language"])} | {("scope", x) for x in r["scope"] or ()}:
                if place[1] is not None:
                    groups.setdefault(place, []).append(r)
    codes = [f"no_cases:{c}" for c in ("answerable", "no_answer_probe") if (c,) not in groups]
    n = len(groups.get(("answerable",), ()))
    checked = rare = 0
    improved = False
    for place, rows in groups.items():
        m = means(rows)
        delta = {x: m[f"c_{x}"] - m[f"b_{x}"] for x in NAMES}
        if len(place) == 1:
            codes += [f"baseline_below_floor:{place[0]}:{x}" for x in policy.absolute if m[f"b_{x}"] < policy.floor]
            codes += [f"{'overall' if place[0] == 'answerable' else place[0]}_regression:{x}" for x in policy.whole if delta[x] < -policy.regression - 1e-12]
            improved |= place[0] == "answerable" and any(delta[x] > 1e-12 for x in policy.sliced)
        elif len(rows) < policy.enough:
            codes.append(f"insufficient_slice:{place[0]}:{place[1]}")
        else:
            checked += 1
            rare += len(rows) <= max(5, math.ceil(n * 0.1))
            codes += [f"slice_regression:{place[0]}:{place[1]}:{x}" for x in policy.sliced if delta[x] < -policy.regression - 1e-12]
    return {"accepted": not codes, "improved": improved, "failure_codes": sorted(codes), "checked_slices": checked, "rare_slices": rare}


SCHEMA = "answerable boolean, language string, scope array<string>, " + ", ".join(f"{s}_{m} double" for s in "bc" for m in NAMES)


@pytest.mark.parametrize("seed", range(4))
def test_shadow_decision_is_the_plain_one(spark, seed):
    rng = random.Random(seed)
    cases = []
    for _ in range(rng.choice([40, 120])):
        r = {"answerable": rng.random() < 0.7, "language": rng.choice(["ru", "en", None]), "scope": rng.choice([None, [], ["a"], ["a", "b", "b"], ["c"]])}
        cases.append(r | {f"{s}_{m}": rng.randint(2, 8) / 8 for s in "bc" for m in NAMES})
    policy = decisions.ShadowPolicy(enough=rng.choice([1, 12]), regression=rng.choice([0.01, 0.1]))
    (got,) = decisions.shadow_decision(spark.createDataFrame(cases, SCHEMA), ["language", "scope"], policy).collect()
    assert got.asDict() == plainly(cases, policy)


def test_shadow_decision_edges(spark):
    even = {"language": "ru", "scope": ["a"]} | {f"{s}_{m}": 0.75 for s in "bc" for m in NAMES}
    both = [even | {"answerable": True}, even | {"answerable": False}]
    (r,) = decisions.shadow_decision(spark.createDataFrame(both, SCHEMA), ["language", "scope"]).collect()
    assert r.asDict() == {"accepted": True, "improved": False, "failure_codes": [], "checked_slices": 2, "rare_slices": 2}
    (r,) = decisions.shadow_decision(spark.createDataFrame([], SCHEMA), ["language", "scope"]).collect()
    assert not r.accepted and r.failure_codes == ["no_cases:answerable", "no_cases:no_answer_probe"]


ONE, TWO = "Расход 2,5 m3/h\r\ncafe\u0301 ", "Other text"
COMPOSED = sha("Расход 2,5 m3/h\ncaf\u00e9")
BASE = {
    "case_id": 1, "scope_id": "scope-sha256:" + sha("o"), "answerable": True, "answer": "It is 2.5 m3/h [1].", "gold_review": False, "bindings": [("c", "s")] * 3, "retrieved": [(1, "d", "r"), (2, "d", "r")], "chunks": [(1, "d", ONE), (2, "d", TWO)],
    "exact": [(1, ONE, COMPOSED, sha(ONE))], "probe": [(2, sha(TWO)), (1, COMPOSED)], "cited": [1], "document_refs": ["r"], "owners": ["o", "o"], "expected": [("2.5", "m3/h")], "supported": [("2.5", "m3/h")],
}
CASES_OF = "case_id int, scope_id string, answerable boolean, answer string, gold_review boolean, bindings array<struct<a:string,b:string>>, retrieved array<struct<chunk_id:int,document_id:string,document_ref:string>>, chunks array<struct<chunk_id:int,document_id:string,text:string>>, exact array<struct<chunk_id:int,quote:string,content_sha256:string,text_sha256:string>>, probe array<struct<chunk_id:int,content_sha256:string>>, cited array<int>, document_refs array<string>, owners array<string>, expected array<struct<value:string,unit:string>>, supported array<struct<value:string,unit:string>>"
NONE = {"answerable": False, "answer": "НЕДОСТАТОЧНО \n данных", "exact": [], "cited": [], "expected": [], "supported": []}
FAULTS = [
    ({}, []), ({"gold_review": True}, []), (NONE, []), (NONE | {"cited": None, "exact": None}, []),
    ({"bindings": [("c", "s"), ("c", "s"), ("c", "t")]}, ["gold_binding"]), ({"bindings": None}, ["gold_binding"]),
    ({"retrieved": [(1, "d", "r")]}, ["retrieval_snapshot"]), ({"retrieved": [(1, "d", "r"), (2, "e", "r")]}, ["retrieval_snapshot"]), ({"probe": [(2, sha(TWO))]}, ["retrieval_snapshot"]), ({"probe": [(2, sha(TWO))], "gold_review": True}, []),
    ({"owners": ["o", "p"]}, ["scope"]), ({"owners": ["p"]}, ["scope"]), ({"owners": []}, ["scope"]), ({"document_refs": ["q"]}, ["scope"]),
    ({"exact": [(1, ONE, sha("x"), sha(ONE))]}, ["exact_quote"]), ({"exact": [(1, ONE, BASE["exact"][0][2], sha(TWO))]}, ["exact_quote"]), ({"probe": [(2, sha(TWO)), (1, sha("x"))]}, ["exact_quote"]),
    ({"exact": [(3, ONE, BASE["exact"][0][2], sha(ONE))]}, ["evidence_coverage", "exact_quote"]), ({"cited": []}, ["evidence_coverage"]), ({"cited": [2, 1]}, []), (NONE | {"cited": [1]}, ["evidence_coverage"]),
    ({"answer": "Insufficient data: 2.5 m3/h"}, ["answerability"]), (NONE | {"answer": "No."}, ["answerability"]), (NONE | {"answer": "资料不足 5"}, ["number_unit"]), (NONE | {"answer": None}, ["answerability"]),
    ({"answer": "It is 2.5 m3/h, 3 bar"}, ["number_unit"]), ({"answer": "It is 2.5 bar"}, ["number_unit"]), ({"expected": [("2", "kg")]}, ["number_unit"]), ({"supported": []}, ["number_unit"]),
]


def test_answer_checks(spark):
    rows = [BASE | change | {"case_id": i} for i, (change, _) in enumerate(FAULTS)]
    got = {r.case_id: r for r in decisions.answer_checks(spark.createDataFrame(rows, CASES_OF)).collect()}
    for i, (change, want) in enumerate(FAULTS):
        assert (got[i].failures, got[i].passed) == (want, not want), change
    assert len(got) == len(FAULTS)


ENOUGH = {"documents": 1, "pages": 5, "heading_edges": 10, "order_pairs": 20, "downstream_cases": 20, "text_continuation": 4, "table_continuation": 4, "image_association": 4}
SCORES = [("structure", s, m, 0.8, 0.8) for s in ("overall", "ru", "en", "zh") for m in ("heading_parent_f1", "order_score", "relation_micro_f1")] + [("downstream", s, m, 0.8, 0.8) for s in ("overall", "ru") for m in ("recall_at_5", "citation_f1")]


def structure(spark, lacking=(), scores=None, validity=(("mapping", True),), runtime=(100.0, 200.0, 36_000.0)) -> tuple:
    rows = [(v, k, n - (1 if (v, k) in lacking else 0)) for v in ("ru", "en", "zh") for k, n in ENOUGH.items()]
    rows += [("de", "pages", 1)]
    changed = {(r[1], r[2]): r for r in (scores if scores is not None else [("structure", "ru", "order_score", 0.8, 0.82)])}
    frames = [
        spark.createDataFrame([r for r in rows if r[2]], "language string, kind string, n long"), spark.createDataFrame([changed.get((r[1], r[2]), r) for r in SCORES], "kind string, scope string, metric string, baseline double, candidate double"),
        spark.createDataFrame(validity, "name string, ok boolean"), spark.createDataFrame([runtime], "b_p95 double, c_p95 double, c_memory_mib double"),
    ]
    (r,) = decisions.structure_gate(*frames).collect()
    return r.eligible, r.accepted, r.failure_codes


@pytest.mark.parametrize("change, eligible, want", [
    ({}, True, []),
    ({"lacking": [("ru", "documents"), ("en", "pages"), ("zh", "downstream_cases")]}, False, ["insufficient_documents:ru", "insufficient_downstream_cases:zh", "insufficient_pages:en"]),
    ({"lacking": [("ru", "image_association"), ("en", "image_association"), ("zh", "image_association")]}, False, ["insufficient_relations:image_association"]),
    ({"scores": []}, True, ["no_material_structure_gain"]),
    ({"scores": [("structure", "zh", "order_score", 0.8, 0.79), ("structure", "ru", "order_score", 0.8, 0.9), ("downstream", "ru", "citation_f1", 0.8, 0.78)]}, True, ["downstream_regression:ru:citation_f1", "structure_regression:zh:order_score"]),
    ({"scores": [("structure", "ru", "order_score", 0.8, 0.9), ("structure", "zh", "order_score", 0.8, 0.796), ("downstream", "ru", "citation_f1", 0.8, 0.795)]}, True, []),
    ({"scores": [("structure", "ru", "order_score", 0.8, None)]}, True, ["no_material_structure_gain", "structure_regression:ru:order_score"]),
    ({"validity": [("mapping", False), ("references", None)]}, True, ["mapping_invalid", "references_invalid"]),
    ({"runtime": (100.0, 201.0, 36_001.0)}, True, ["latency_budget_exceeded", "memory_budget_exceeded"]),
    ({"runtime": (0.0, 1.0, None)}, True, ["latency_budget_exceeded", "memory_budget_exceeded"]),
])
def test_structure_gate(spark, change, eligible, want):
    assert structure(spark, **change) == (eligible, not want, want)


def test_preflight(spark):
    good = {
        "schema": "7", "rows": 5, "embedded": 5, "finite": True, "vector_type": "v64", "index_valid": True, "row_security": True, "bypasses": False, "owns": False, "leaks": 0, "stable": True, "complete": True, "exact_used_index": 0, "coverage": 1.0,
        "natural_coverage": 0.2, "recall": 0.99, "plain_recall": 0.98, "fill": 0.99, "p95": 104.0, "exact_p95": 100.0, "violations": 0,
    }
    cases = [
        ({}, []), ({"complete": False}, ["incomplete_run"]), ({"schema": None}, ["unexpected_version:schema"]), ({"embedded": 4}, ["vectors_missing"]), ({"finite": None}, ["vectors_not_finite"]), ({"vector_type": "v32"}, ["unexpected_vector_type"]), ({"index_valid": False}, ["index_invalid"]),
        ({"row_security": False}, ["unsafe_role"]), ({"bypasses": True}, ["unsafe_role"]), ({"owns": True}, ["unsafe_role"]), ({"leaks": 1}, ["owner_probe_failed"]), ({"stable": False}, ["corpus_changed"]), ({"exact_used_index": 1}, ["exact_search_used_index"]), ({"coverage": 0.5}, ["index_not_usable_in_every_scope"]),
        ({"recall": float("nan")}, ["measures_not_finite"]), ({"exact_p95": 0.0}, ["measures_not_finite"]), ({"fill": None, "recall": 0.1}, ["measures_not_finite"]), ({"recall": 0.98}, ["recall_below_limit", "no_recall_gain"]), ({"fill": 0.98}, ["fill_below_limit"]), ({"p95": 105.1}, ["p95_regressed"]), ({"plain_recall": 0.986}, ["no_recall_gain"]),
        ({"violations": 1}, ["scope_violated"]), ({"natural_coverage": 0.0}, ["index_never_chosen"]),
    ]
    types = {str: "string", bool: "boolean", int: "int", float: "double"}
    schema = "i int, " + ", ".join(f"`{k}` {types[type(v)]}" for k, v in good.items())
    df = spark.createDataFrame([{"i": i} | good | change for i, (change, _) in enumerate(cases)], schema)
    for r in decisions.preflight(df, decisions.PreflightPolicy({"schema": "7"}, "v64")).collect():
        want = cases[r.i][1]
        assert (r.reasons, r.decision) == (want, "no_go" if want else "requires_full_comparison"), cases[r.i][0]
