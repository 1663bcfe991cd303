from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest

from sparkloom.llm import warc
from sparkloom.llm.common import fresh_dir
from sparkloom.llm.queries import op6_warc, table


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            d = html or ""
            first[d] = min(i, first.get(d, i))
    out = []
    for i, _, html in rows:
        d = html or ""
        f = first.get(d)
        refers = None if f is None or f == i else f
        out.append((i, len(d.encode()), digest(d.encode()), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    assert got(op6_warc(spark, sf)) == expected(rows)


@pytest.fixture
def pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdef <>é日\r\n", k=rng.randint(0, 4000)))) for i in range(60)]
    rows += [(100, None, None), (101, "http://x", ""), (102, "u\r\nWARC-Type: evil", rows[3][2]), (None, "http://n", rows[4][2]), (5, "http://again", rows[5][2]), (103, "z", "WARC/1.1\r\n\r\n\x1f\x8b\x08")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' as digest", "'b' as first", "1 as n")
    return rows, df.repartition(3)


@pytest.mark.parametrize("split", [64, 997, 8 << 20])
def test_every_split_size_reads_every_record_once(spark, pages, split, monkeypatch):
    monkeypatch.setattr(warc, "MOST_TASKS", 4)
    rows, df = pages
    manifest = warc.write_warc(df, fresh_dir(spark, "warc"))
    back = warc.read_warc(spark, manifest, split).collect()
    assert len(back) == len(rows) == sum(r.records for r in manifest.collect())
    assert got(warc.round_trip(df)) == expected(rows)
    html = {r.record_id: r.payload.decode() for r in back if r.record_type == "response"}
    assert all(html[str(i)] == (h or "") for i, _, h in rows if str(i) in html)
    assert {r.uri for r in back if r.record_id == "100"} == {None}


def test_archives_are_gzip_members(spark, pages):
    _, df = pages
    path = warc.write_warc(df, fresh_dir(spark, "warc")).first().path.removeprefix("file:")
    assert gzip.open(path.replace("///", "/")).read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_empty_table(spark, pages):
    assert got(warc.round_trip(pages[1].limit(0))) == []
