"""Gold sets: line numbers over splits, every rule by a case that breaks it, and rules of the whole set."""

from __future__ import annotations

import copy
import hashlib
import json

import pytest

from sparkloom.sources import gold


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def case(n: int = 0, **changes) -> dict:
    source, content = sha("source"), sha("content")
    document = {"document_ref": f"doc-sha256:{source}", "source_sha256": source, "parsed_content_sha256": sha("parsed"), "page_count": 5}
    evidence = {"evidence_id": f"ev-sha256:{source}:p2:text:{content}", "document_ref": f"doc-sha256:{source}", "page": 2, "content_type": "text", "content_sha256": content, "relevance_grade": 3, "bbox": [0, 0.25, 1, 0.5]}
    question = changes.get("question") or f"What is the pressure of pump {n}?"
    out = {
        "schema_version": "rag-gold-v1", "case_id": f"ragq-case{n:06d}", "status": "candidate", "scope_id": f"scope-sha256:{sha('owner')}", "language": "en", "question": question, "question_sha256": sha(question), "answerable": True,
        "reference_answer": "Ten bar", "reference_answer_sha256": sha("Ten bar"), "hop_type": "single", "content_types": ["text"], "challenge_tags": ["units"], "document_scope": [document], "evidence": [evidence], "review": None,
    }
    return out | changes


def other(target: dict, **changes) -> dict:
    return target | changes


C = case()
D, E = C["document_scope"][0], C["evidence"][0]
UNANSWERED = {"answerable": False, "reference_answer": None, "reference_answer_sha256": None, "evidence": []}
REVIEW = {"reviewer_id": "rev-1", "reviewed_at": "2026-01-02T03:04:05+00:00", "case_sha256": gold.case_sha256(json.dumps(C))}
CASES = [
    (C, []),
    (case(**UNANSWERED), []),
    (other(C, status="reviewed", review=REVIEW), []),
    (other(C, question="  " + C["question"] + "\r\n"), []),
    (other(C, case_id="ragq-X"), [("case_id", "pattern")]),
    (other(C, question="short", question_sha256=sha("short")), [("question", "length")]),
    (other(C, answerable="yes"), [("answerable", "type")]),
    (other(C, answerable=1), [("answerable", "type")]),
    (other(C, secret=1), [("<field>", "unknown")]),
    ({k: v for k, v in C.items() if k != "review"}, [("review", "missing")]),
    (other(C, content_types=[]), [("content_types", "length")]),
    (other(C, challenge_tags=["units", "jokes"]), [("challenge_tags", "choice")]),
    (other(C, document_scope=[1]), [("document_scope.0", "type")]),
    (other(C, evidence=[other(E, page="2", bbox=[0, 1, 2])]), [("evidence.0.page", "type"), ("evidence.0.bbox", "box")]),
    (other(C, evidence=[other(E, page=True)]), [("evidence.0.page", "type")]),
    (other(C, evidence=[other(E, relevance_grade=4)]), [("evidence.0.relevance_grade", "range")]),
    (other(C, status="reviewed", review=other(REVIEW, reviewed_at="2026-01-02T03:04:05")), [("review.reviewed_at", "pattern")]),
    (other(C, status="reviewed", review=other(REVIEW, reviewed_at="2026-13-02T03:04:05Z")), [("review.reviewed_at", "time")]),
    (other(C, question_sha256=sha("x")), [("record", "question_sha256")]),
    (other(C, content_types=["text", "text"]), [("record", "content_types_unique")]),
    (other(C, challenge_tags=["units", "units"]), [("record", "challenge_tags_unique")]),
    (other(C, document_scope=[D, D]), [("record", "document_scope_unique")]),
    (other(C, document_scope=[other(D, source_sha256=sha("y"))]), [("record", "document_ref")]),
    (other(C, document_scope=[other(D, page_count=1)]), [("record", "evidence_page")]),
    (other(C, evidence=[E, E]), [("record", "evidence_unique")]),
    (other(C, evidence=[other(E, page=3)]), [("record", "evidence_id")]),
    (other(C, evidence=[other(E, bbox=[0.5, 0, 0.5, 1])]), [("record", "bbox")]),
    (other(C, evidence=[other(E, bbox=[0, 0, 1.5, 1])]), [("record", "bbox")]),
    (other(C, content_types=["table"]), [("record", "evidence_content_type")]),
    (other(C, evidence=[]), [("record", "evidence_of_answer")]),
    (other(C, reference_answer=None), [("record", "answer")]),
    (other(C, reference_answer="Nine bar"), [("record", "answer_sha256")]),
    (case(**other(UNANSWERED, evidence=[E])), [("record", "evidence_of_answer")]),
    (other(C, hop_type="multi"), [("record", "hop_evidence")]),
    (other(C, hop_type="cross_document"), [("record", "hop_evidence")]),
    (other(C, challenge_tags=["leakage"]), [("record", "leakage_refused")]),
    (other(C, review=REVIEW), [("record", "review")]),
    (other(C, status="reviewed"), [("record", "review")]),
    (other(C, status="reviewed", review=REVIEW, language="ru"), [("record", "case_sha256")]),
]


def test_every_rule(spark):
    raw = [(None, [("record", "blank")]), (" ", [("record", "blank")]), ("[1]", [("record", "type")]), ("{", [("record", "json")]), ('{"a":1,"a":2}', [("record", "repeated key")]), ('{"a":NaN}', [("record", "json")]), ('"' + "x" * gold.LINE_BYTES + '"', [("record", "size")])]
    told = [(json.dumps(c), want) for c, want in CASES] + raw
    far = copy.deepcopy(C)
    far["evidence"][0] |= {"document_ref": f"doc-sha256:{sha('z')}", "evidence_id": f"ev-sha256:{sha('z')}:p2:text:{sha('content')}"}
    told.append((json.dumps(far), [("record", "evidence_in_scope")]))
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(told)], "id int, value string")
    rows = gold.checked(df).orderBy("id").collect()
    for r, (line, want) in zip(rows, told, strict=True):
        assert sorted((f.place, f.rule) for f in r.faults) == sorted(want), line and line[:400]
        assert (r.record is None) == bool(want)


@pytest.mark.parametrize("split", [300, 5000, 1 << 27])
def test_lines_are_numbered_over_splits(spark, tmp_path, split):
    for name, n in (("a", 500), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = gold.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 503 and all(r.value == f"{r.path[-7]} {r.line}" for r in rows)


def test_repeated_cases_and_the_report(spark):
    rows = [case(i) for i in range(6)] + [case(7, **UNANSWERED), case(8, **other(UNANSWERED, challenge_tags=["leakage"])), other(case(9), case_id=case(0)["case_id"]), other(case(1), case_id="ragq-another1")]
    df = gold.checked(spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(rows)], "id int, value string"))
    assert sorted(tuple(r) for r in gold.faults(df, ["id"]).collect()) == [(0, "case_id", "repeated"), (1, "question_sha256", "repeated"), (8, "case_id", "repeated"), (9, "question_sha256", "repeated")]
    (r,) = gold.report(df, least=5, most=50).collect()
    assert (r.records, r.no_answer, r.counts["languages:en"], r.counts["hop_types:single"]) == (10, 1, 10, 8)
    assert r.failures == ["case_id", "question", "no_answer_share", "languages", "hop_types", "content_types", "challenge_tags"]
    (r,) = gold.report(df.where("id in (2, 6)"), True, least=3).collect()
    assert (r.records, r.no_answer) == (2, 1) and r.failures[0] == "record_count" and r.failures[-1] == "not_reviewed"


def test_empty_set(spark):
    df = gold.checked(spark.createDataFrame([], "id int, value string"))
    assert gold.faults(df, ["id"]).count() == 0
    (r,) = gold.report(df).collect()
    assert r.records == 0 and "record_count" in r.failures
