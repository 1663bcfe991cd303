"""URL filters and decontamination: against SQL on the tables and against small hand-made cases."""

from __future__ import annotations

import datetime
import hashlib

import compare
import pytest

from sparkloom.llm import decontamination, queries, urlfilter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare.differences(queries.queries()[name](spark, SF), compare.connect(SF), queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["op2_url_filters", "op5_decontamination"])
def test_no_python_in_the_plan(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.fixture
def benchmark(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string")

    return make


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_decontamination_cases(documents, benchmark):
    thirteen = " ".join(f"w{i}" for i in range(13))
    bench = benchmark([(10, thirteen), (9, "Short item"), (8, None), (7, "..."), (10, thirteen), (3, "Étude UNO")])
    docs = documents([(1, None), (2, ""), (3, "x " + thirteen.upper() + ", w12"), (4, "a short ITEM short item b"), (5, "Étude uno"), (6, "étude uno"), (7, "w0 " * 1000), (8, ("z " * 300) + "short item"), (None, "short item")])
    got = result(decontamination.judged(docs, bench))
    assert got[1] == got[2] == (0, 0, 0, sha(""), False)
    assert got[3] == (15, 13, 1, sha("10"), True)
    assert got[4] == (6, 4, 1, sha("9"), True)
    assert got[5] == (2, 2, 1, sha("3"), True)
    assert got[6] == (2, 0, 0, sha(""), False)  # only A-Z are lower-cased
    assert got[7][1] == 0 and got[8] == (302, 2, 1, sha("9"), False)
    kept = decontamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 6, 7, 8]
    assert got[None] == (2, 2, 1, sha("9"), True)  # a null id is judged as any other
    cut = {r.doc_id: r.text for r in decontamination.without_spans(docs, bench).collect()}
    assert cut[4] == "a b" and cut[6] == "étude uno" and cut[1] is None


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, documents, benchmark):
    thirteen = " ".join(f"w{i}" for i in range(13))
    rows = [(1, thirteen), (1, "other words only here"), (1, None), (None, thirteen), (None, "clean"), (2, thirteen + " more"), (2, thirteen + " more")]
    bench = benchmark([(10, thirteen)])
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in decontamination.judged(documents(rows), bench).collect())
    assert got == sorted([("1", 13, 13, True), ("1", 4, 0, False), ("1", 0, 0, False), ("None", 13, 13, True), ("None", 1, 0, False), ("2", 14, 13, True), ("2", 14, 13, True)])
    kept = decontamination.without_contaminated(documents(rows), bench)
    assert kept.columns == documents(rows).columns and sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("1", "other words only here"), ("None", "clean")] and kept.count() == 3
    cut = sorted((str(r.doc_id), r.text or "") for r in decontamination.without_spans(documents(rows), bench).collect())
    assert cut == sorted([("1", ""), ("1", "other words only here"), ("1", ""), ("None", ""), ("None", "clean"), ("2", " more"), ("2", " more")])
    con = compare.duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO benchmark VALUES (10, ?)", [thirteen])
    assert compare.differences(decontamination.judged(documents(rows), bench).drop("row"), con, decontamination.ORACLE) == ""


def test_decontamination_empty_tables(documents, benchmark):
    assert result(decontamination.judged(documents([(1, "a b")]), benchmark([]))) == {1: (2, 0, 0, sha(""), False)}
    assert result(decontamination.judged(documents([]), benchmark([(1, "a b")]))) == {}


def test_overlapping_spans_count_once(documents, benchmark):
    words = [f"w{i}" for i in range(20)]
    got = result(decontamination.judged(documents([(1, " ".join(words))]), benchmark([(1, " ".join(words[:15])), (2, " ".join(words[5:])), (3, "w3 w4")])))
    assert got[1] == (20, 20, 3, sha("1,2,3"), True)


def day(n):
    return datetime.date(2024, 1, n)


def test_url_filter_cases(spark):
    changes = spark.createDataFrame(
        [
            ("abuse", "block", "bad.com", "add", day(5)), ("abuse", "block", "bad.com", "add", day(6)), ("abuse", "block", "bad.com", "remove", day(10)), ("abuse", "block", "bad.com", "add", day(20)),
            ("good", "allow", "ok.bad.com", "add", day(1)), ("abuse", "block", "ok.bad.com/x", "add", day(7)), ("abuse", "block", None, "add", day(1)), ("abuse", "block", "never.com", "remove", day(1)),
        ],
        "list string, rule string, pattern string, action string, at date",
    )
    rows = [
        (1, "http://bad.com/", day(4)), (2, "http://user@WWW.Bad.com.:8080/a?q#f", day(5)), (3, "http://bad.com", day(10)), (4, "http://bad.com", day(25)), (5, "https://ok.bad.com/y", day(6)),
        (6, "https://ok.bad.com/x/y", day(8)), (7, None, day(8)), (8, "notaurl", day(8)), (9, "http://never.com", day(8)), (10, "http://bad.com", None), (11, "http://bad.com", day(6)), (11, "http://bad.com", day(6)), (12, "http://notbad.com", day(6)),
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date").selectExpr("*", "'x' as list", "'y' as host", "1 as key")
    got = {r.page_id: (r.verdict, r.n_active, r.copies) for r in urlfilter.filter_captures(captures, changes).collect()}
    assert got == {
        1: ("unmatched", 0, 1), 2: ("block", 1, 1), 3: ("unmatched", 0, 1), 4: ("block", 1, 1), 5: ("allow", 2, 1), 6: ("block", 3, 1), 7: ("invalid", 0, 1), 8: ("invalid", 0, 1), 9: ("unmatched", 0, 1),
        10: ("unmatched", 0, 1), 11: ("block", 1, 2), 12: ("unmatched", 0, 1),
    }
    kept = urlfilter.kept_captures(captures, changes)
    assert kept.columns == captures.columns and sorted(r.page_id for r in kept.collect()) == [1, 3, 5, 7, 8, 9, 10, 12]
    assert urlfilter.filter_captures(captures, changes.limit(0)).where("n_active > 0").count() == 0
    assert urlfilter.filter_captures(captures.limit(0), changes).count() == 0


def test_words_are_lower_cased_one_by_one(documents, benchmark):
    """A capital sigma's lower case depends on its neighbours; only A-Z are lower-cased."""
    text = "\u039f\u03a3'\u0391 one two three four five six seven eight nine ten eleven twelve thirteen"
    got = result(decontamination.judged(documents([(1, text), (2, "\u039f\u03a3 \u0391"), (3, "\u0130x I\u0307X")]), benchmark([(1, text), (2, "\u039f\u03a3'\u0391"), (3, "\u0130X")])))
    assert got[1][:3] == (15, 15, 2) and got[2][:3] == (2, 2, 1) and got[3][:3] == (2, 1, 1)


def test_windows_beyond_one_broadcast(spark):
    docs, bench = (queries.table(spark, SF, t) for t in ("documents", "benchmark"))
    want = result(decontamination.judged(docs, bench))
    assert result(decontamination.judged(docs, bench, at_once=100)) == want and sum(r[1] for r in want.values()) > 0
