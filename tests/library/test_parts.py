from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import chunking, matching, sampling


def plain_parts(text, limit):
    rest, out = text.strip(), []
    while len(rest) > limit:
        at = rest.rfind(" ", 0, limit + 1)
        at = limit if at < max(1, limit // 3) else at
        if rest[:at].strip():
            out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [*out, rest] if rest else out


def test_bounded_parts_hold_all_words(spark):
    texts = ["", "one two three four five six seven", "a" * 25 + " bb", "ab cd " * 30, "x " + "y" * 50]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chunking.bounded_parts(F.col("t"), 12).alias("p")).collect()]
    assert all(len(p) <= 12 for parts in got for p in parts)
    assert ["".join(p).replace(" ", "") for p in got] == [t.replace(" ", "") for t in texts]
    assert got[1] == plain_parts(texts[1], 12) and got[3] == plain_parts(texts[3], 12)


def test_quota_selection_moves_groups(spark):
    """One stratum can only use a group that the other would take first."""
    rows = [("1", "a", "g"), ("2", "a", "h"), ("3", "b", "g"), ("4", "b", "g")]
    df = spark.createDataFrame(rows, "id string, stratum string, `group` string")
    chosen, short = matching.quota_selection(df, {"a": 1, "b": 1}, "s")
    assert short == {} and {(s, g) for s, _, g in chosen} == {("a", "h"), ("b", "g")}
    assert matching.quota_selection(df, {"a": 2, "b": 1}, "s")[1] != {}


def test_gap_pairs_of_texts_without_words(spark):
    """A text without words, and none at all, are like no other: only the gap counts."""
    rows = spark.createDataFrame([(1, 1, ["a"]), (1, 2, []), (1, 3, None), (1, 4, ["a"])], "g int, t int, w array<string>")
    got = {(r.a, r.b): r.score for r in sampling.gap_pairs(rows, "g", "t", "w").collect()}
    assert got == {(1, 2): 0.1, (1, 3): 0.05, (1, 4): 1.033333, (2, 3): 0.1, (2, 4): 0.05, (3, 4): 0.1}
