"""Whole replacement of documents: revisions, two writers, and one that fails."""

from __future__ import annotations

import pytest

from sparkloom.sources import replaced

ROWS = "document_id string, revision int, idx int, text string"


def write(spark, path, documents, rows, **more):
    return replaced.replace(spark, path, spark.createDataFrame(documents, "document_id string, revision int"), spark.createDataFrame(rows, ROWS), "document_id", "revision", **more)


def held(spark, path):
    return sorted((r.document_id, r.revision, r.idx, r.text) for r in replaced.read(spark, path).collect())


def test_revisions(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert replaced.read(spark, path) is None
    number, refused = write(spark, path, [("a", 1), ("b", 5), ("c", 1)], [("a", 1, 0, "x"), ("a", 1, 1, "y"), ("b", 5, 0, "z"), ("c", 1, 0, "c"), ("unlisted", 1, 0, "-")], buckets=2)
    assert number == 1 and refused.collect() == []
    number, refused = write(spark, path, [("a", 2), ("b", 4), ("c", 1), ("d", 1)], [("a", 2, 0, "new"), ("b", 4, 0, "old"), ("d", 1, 0, "d")])
    assert number == 2 and [tuple(r) for r in refused.collect()] == [("b", 4, 5)]
    assert held(spark, path) == [("a", 2, 0, "new"), ("b", 5, 0, "z"), ("d", 1, 0, "d")]  # c has no chunks any more
    write(spark, path, [("a", 3), ("b", 6), ("d", 2)], [])
    assert held(spark, path) == [] and replaced.manifest(spark, path)[0] == 3


def test_second_writer_starts_again_on_the_first_ones_work(spark, tmp_path):
    path, once = f"{tmp_path}/t", []
    write(spark, path, [("a", 1), ("b", 1)], [("a", 1, 0, "a1"), ("b", 1, 0, "b1")], buckets=1)

    def other():
        if not once:
            once.append(write(spark, path, [("a", 3)], [("a", 3, 0, "a3")]))

    number, refused = write(spark, path, [("a", 2), ("b", 2)], [("a", 2, 0, "a2"), ("b", 2, 0, "b2")], before_publishing=other)
    assert number == 3 and [tuple(r) for r in refused.collect()] == [("a", 2, 3)]
    assert held(spark, path) == [("a", 3, 0, "a3"), ("b", 2, 0, "b2")]


def test_failed_writer_leaves_nothing_to_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    write(spark, path, [("a", 1)], [("a", 1, 0, "a1")])

    def fail():
        raise OSError("lost")

    with pytest.raises(OSError):
        write(spark, path, [("a", 2)], [("a", 2, 0, "a2")], before_publishing=fail)
    assert held(spark, path) == [("a", 1, 0, "a1")] and replaced.manifest(spark, path)[0] == 1
    with pytest.raises(RuntimeError):
        write(spark, path, [("a", 2)], [("a", 2, 0, "a2")], attempts=1, before_publishing=lambda: write(spark, path, [("z", 1)], [("z", 1, 0, "z")]))
