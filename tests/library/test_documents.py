"""Chunking, readers, statistics, streaming on small fixtures."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chunking, stats
from sparkloom.sources import files
from sparkloom.streaming import events

SEGMENT = "document_id string, id string, idx int, kind string, heading_level int, page_idx int, source_text string, translated_text string, image string"


@pytest.fixture
def segments(spark):
    def make(rows):
        return spark.createDataFrame([("d", f"s{i}", i, k, lvl, p, t, r, img) for i, (k, lvl, p, t, r, img) in enumerate(rows)], SEGMENT)

    return make


def test_chunks_follow_headings(segments):
    df = segments(
        [("heading", 1, 0, "1. Scope", None, None), ("paragraph", None, 0, "a" * 300, "б" * 300, None), ("heading", 2, 1, "1.1 Details", None, None), ("paragraph", None, 1, "b" * 300, None, None), ("table", None, 1, "x | y", None, None), ("paragraph", None, 2, "c" * 100, None, None),
         ("image", None, 2, None, None, "k1"), ("paragraph", None, 2, "Figure 3 pump", "Рис. 3", None), ("heading", 1, 3, "2. Materials", None, None), ("paragraph", None, 3, "d" * 3900, None, None), ("paragraph", None, 4, "e" * 3900, None, None)]
    )
    rows = {r.idx: r for r in chunking.chunked(df).collect()}
    assert [rows[i].kind for i in sorted(rows)] == ["section", "table", "section", "image", "section", "section"]
    assert rows[0].heading_path == "1. Scope" and rows[0].text_ru.endswith("б" * 300) and rows[0].page_start == 0
    assert rows[1].heading_path == "1. Scope → 1.1 Details → таблица" and rows[2].page_end == 2 and rows[2].segment_ids == ["s2", "s3", "s5"]
    assert rows[3].text_en == "Figure 3 pump" and rows[3].text_ru == "Рис. 3"
    assert rows[4].heading_path == rows[5].heading_path == "2. Materials" and rows[5].page_start == 4


def test_heading_paths_equal_a_plain_stack(spark, segments):
    rng = random.Random(1)
    rows = [("heading" if rng.random() < 0.6 else "paragraph", rng.randint(1, 4), 0, f"t{i}", None, None) for i in range(60)]
    stack, want = [], {}
    for i, (kind, level, _, title, _, _) in enumerate(rows):
        if kind == "heading":
            stack = [*stack[: level - 1], title]
            want[i] = stack
    assert {r.idx: r.path for r in chunking.heading_paths(segments(rows)).collect()} == want


def test_deduplicated(spark):
    rows = [(1, 1, "a", "d", ["s1", "s2"]), (1, 2, "b", "d", ["s1"]), (1, 3, "a", "d", ["s9"]), (1, 4, "c", "e", ["s1"]), (1, 5, "x", "d", None), (2, 1, "b", "d", ["s1"])]
    df = spark.createDataFrame(rows, "query_id long, position int, id string, document_id string, segment_ids array<string>")
    kept = lambda n: sorted((r.query_id, r.position) for r in chunking.deduplicated(df, n).collect())
    assert kept(0) == [(1, 1), (1, 4), (1, 5), (2, 1)] and kept(2) == [(1, 1), (1, 2), (1, 4), (1, 5), (2, 1)]


def test_table_grid(spark):
    html = '<table><tr><th rowspan="2">Pump</th><th colspan="2">500 rpm</th></tr><tr><td>Flow</td><td>Head</td></tr><tr><td>A</td><td>1</td><td>2</td></tr><tr><td></td></tr></table>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "no table")], "id long, html string")
    rows = {r.id: (r.g, r.ok) for r in df.select("id", files.table_grids("html").alias("g")).withColumn("ok", files.rectangular(F.col("g"))).collect()}
    assert rows[1] == ([["Pump", "500 rpm", ""], ["", "Flow", "Head"], ["A", "1", "2"]], True) and rows[2][0] == rows[3][0] == []


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 1, "a": 2}\n{"a": NaN}\nnot json\n{"z": 1}\n')
    rows = files.strict_json_lines(spark, str(tmp_path / "g.jsonl"), "a int, b string").collect()
    assert [r.problem is None for r in rows] == [True, False, False, False, False] and rows[0].record.b == "x"


def test_canonical_json(spark):
    df = spark.createDataFrame([(2, None, "é")], "b int, c string, a string")
    assert files.canonical_json(df).first().value == '{"a":"é","b":2,"c":null}'


def test_office_files(spark, tmp_path):
    def put(name, parts):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)

    w, a, s = (x[1:-1] for x in (files.W, files.A, files.S))
    put("a.docx", {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    put("b.pptx", {f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="x" xmlns:a="{a}"><a:p><a:r><a:t>slide {i}</a:t></a:r></a:p></p:sld>' for i in (10, 2)})
    put("c.xlsx", {"xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>x</t></si><si><t>y</t></si></sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row></worksheet>'})
    found = files.office_texts(spark, str(tmp_path))
    assert sorted((r.kind, r.place, r.text) for r in found.collect()) == [("docx", "paragraph 0.0", "One two"), ("docx", "table 1.0", "cell"), ("pptx", "slide10 0", "slide 10"), ("pptx", "slide2 0", "slide 2"), ("xlsx", "sheet1 A1", "x"), ("xlsx", "sheet1 C1", "y"), ("xlsx", "sheet1 D1", "x")]
    assert files.distinct_cells(found.where("kind = 'xlsx'")).count() == 2


def test_cluster_bootstrap(spark):
    rows = [("m", f"c{i % 5}", float(i % 3), float(i % 3) + (i % 2)) for i in range(40)] + [("one", "c", 1.0, 2.0)]
    got = {r.metric: r for r in stats.cluster_bootstrap(spark.createDataFrame(rows, "metric string, cluster_id string, baseline double, candidate double"), "metric", 200, 7).collect()}
    clusters = [(sum(c - b for _, k, b, c in rows[:40] if k == f"c{i}"), 8) for i in range(5)]
    rng, drawn = random.Random(stats.seed_of(7, "m")), []
    for _ in range(200):
        picked = [clusters[rng.randrange(5)] for _ in range(5)]
        drawn.append(sum(s for s, _ in picked) / sum(n for _, n in picked))
    drawn.sort()
    assert got["m"].low == pytest.approx(stats.quantile(drawn, 0.025)) and got["m"].high == pytest.approx(stats.quantile(drawn, 0.975))
    assert got["m"].improvement == pytest.approx(0.5) and got["m"].clusters == 5 and got["one"].low is None


def test_shared_clusters(spark):
    pairs = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "z"), (4, "c"), (5, "c")] + [(10 + i, f"l{i}") for i in range(20)] + [(11 + i, f"l{i}") for i in range(20)]
    got = {r.case: r.cluster for r in stats.shared_clusters(spark.createDataFrame(pairs, "case long, document string"), "case", "document").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, 4: 4, 5: 4} | {10 + i: 10 for i in range(21)}


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.source(spark, str(tmp_path / "in"), "*.parquet")
    events.run_once(events.windowed(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    batch = events.windowed(table.withColumn("ts", F.col("ts").cast("timestamp")))
    streamed = spark.read.parquet(str(tmp_path / "out"))
    # The last windows stay open until the watermark passes them; all that were closed agree.
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() > 0
    assert events.sessions(table.withColumn("ts", F.col("ts").cast("timestamp"))).agg(F.sum("n")).first()[0] == table.count()


def plain_chunks(rows, most, least):
    """Chunks of one document by a loop: (kind, path, segment ids)."""
    path, out, held, ids, under = [], [], 0, [], []
    texts = {}

    def close():
        nonlocal held, ids
        en, ru = ("\n".join(t for t in (texts[i][n] for i in ids) if t or n) for n in (0, 1))
        if ids and len(en.strip()) + len(ru.strip()) >= least // 2:
            out.append(("section", " → ".join(under), list(ids)))
        held, ids = 0, []

    for i, (_, ident, _, kind, level, _, text, other, image) in enumerate(rows):
        after = rows[i + 1] if i + 1 < len(rows) else None
        texts[ident] = (text or "", other or text or "")
        if kind == "heading":
            close()
            path = [*path[: max(level or 1, 1) - 1], (text or "").strip()]
        elif kind == "image":
            if (text or "").strip() or image or (after and after[3] == "paragraph" and (after[6] or "").startswith("Figure ")):
                close()
                out.append(("image", " → ".join(path), [ident]))
            continue
        elif kind == "table":
            out.append(("table", " → ".join([*path, "таблица"]), [ident]))
            continue
        if held + len(text or "") > most and held > least:
            close()
        held, ids, under = held + len(text or ""), [*ids, ident], path
    close()
    return out


def test_chunks_equal_a_plain_loop_also_without_a_document_id(spark):
    rng, rows = random.Random(5), {}
    for name, n in (("a", 150), (None, 90), ("b", 1)):
        rows[name] = []
        for i in range(n):
            kind = rng.choice(["heading", "paragraph", "paragraph", "paragraph", "table", "image"])
            text = rng.choice([None, "", "Figure 3 pump", "w" * rng.randrange(1, 90)])
            rows[name].append((name, f"{name}-{i}", 2 * i, kind, rng.choice([None, 0, 1, 2, 3, 5]) if kind == "heading" else None, i, text or ("x" if kind == "heading" else text), rng.choice([None, "", "д" * 30]), rng.choice([None, "k"])))
    df = spark.createDataFrame([r for some in rows.values() for r in some], SEGMENT).repartition(7)
    got = {}
    for r in chunking.chunked(df, 120, 20).collect():
        got.setdefault(r.document_id, {})[r.idx] = (r.kind, r.heading_path, r.segment_ids)
    for name in rows:
        want = plain_chunks(rows[name], 120, 20)
        mine = got.get(name, {})
        assert sorted(mine) == list(range(len(want)))
        # A table stands where it is, a section where it is complete.
        assert sorted(mine.values()) == sorted(want)


def test_lengths_without_texts_equal_those_of_joined_texts(spark):
    rng = random.Random(9)
    bits = ["", " ", "\n", "\u00a0", "\u2003\t", "a", "ж b", "\u0085", "x\ny", "\u200b"]
    lists = [["".join(rng.choices(bits, k=rng.randrange(4))) for _ in range(rng.randrange(6))] for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, texts array<string>")
    # Extents are found text by text, as columns.
    each = df.select("i", F.posexplode("texts").alias("n", "t")).withColumn("x", chunking._extent(F.col("t"))).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("n", "t", "x"))).alias("l"))
    got = each.select("l", chunking._joined_length(F.transform("l", lambda y: y["x"])).alias("length"), F.char_length(chunking.stripped(F.array_join(F.transform("l", lambda y: y["t"]), "\n"))).alias("want")).collect()
    assert len(got) > 200 and [r.length for r in got] == [r.want for r in got]


def plain_texts(rows):
    """Texts of a document's only section."""
    strip = lambda t: t.strip(" \n\u00a0")
    en = strip("\n".join(t for _, t, _ in rows if t))
    return en, strip("\n".join(r or t or "" for _, t, r in rows)), [i for i, *_ in rows]


@pytest.mark.parametrize("section_chunks", [1, 64])
def test_short_sections_repeated_segments_and_long_sections(spark, monkeypatch, section_chunks):
    monkeypatch.setattr(chunking, "SECTION_CHUNKS", section_chunks, raising=False)
    docs = {
        "short": [("a", " x\u00a0", None), ("b", "\n", "")],  # 1 and 1 characters
        "white": [("a", " " * 50, None), ("b", "x", None)],
        "enough": [("a", "x" * 4, None), ("b", "", None), ("c", "\n", None), ("d", "y ", None)],  # 7 and 9 with the lines between
        "other": [("a", None, "z" * 20), ("b", None, None)],
        "same": [("a", "s" * 9, None)] * 3,  # one segment three times
    }
    rows = [(d, i, 0 if d == "same" else n, "paragraph", None, n, t, r, None) for d, some in docs.items() for n, (i, t, r) in enumerate(some)]
    rows += [("long", f"{n}", n, "heading" if n == 0 else "table", 1 if n == 0 else None, n, f"t{n}" * 20, None, None) for n in range(9)]
    got = {}
    for r in chunking.chunked(spark.createDataFrame(rows, SEGMENT), 120, 32).collect():
        got.setdefault(r.document_id, []).append(r)
    want = {d: plain_texts(some) for d, some in docs.items()}
    want = {d: x for d, x in want.items() if len(x[0]) + len(x[1]) >= 16}
    assert set(want) == {"enough", "other", "same"}
    assert {d: (r.text_en, r.text_ru, r.segment_ids) for d, (r, *more) in got.items() if d != "long" and not more} == want
    long = sorted(got["long"], key=lambda r: r.idx)
    assert [r.segment_ids for r in long] == [[str(n)] for n in (*range(1, 9), 0)] and [r.heading_path for r in long] == ["t0" * 20 + " → таблица"] * 8 + ["t0" * 20]
