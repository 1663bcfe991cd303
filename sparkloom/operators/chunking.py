"""Structural chunking of a document's segments.

The order of a document's segments decides its headings and chunks: running sums and maxima over
ranges of a document's rows, and one pass over the lengths of the texts between two headings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kept import measured
from .ordered import running_in_parts

MAX_CHARS, MIN_CHARS = 4000, 200
#: Beginnings of captions; a fixed value.
CAPTION = r"(?i)^\s*(figure|fig\.?|рис\.?|рисунок|table|таблиц[аы]|схема|диаграмма)\s*\.?\s*\d"
#: White space of Unicode.
SPACE = r"(?U:\s)"
ARROW, TABLE_STEP = " → ", "таблица"
#: Beyond every place in a document.
LAST = (1 << 63) - 1


def outlines(segments: DataFrame, translated: Callable[[Column], Column] | None = None) -> DataFrame:
    """Segments without their texts: ``of`` names the texts (see ``texts_of``), ``en`` and ``ru`` say how long they and their white space are."""
    texts = segments.withColumns({"_of": text_key(segments), "_en": F.coalesce("source_text", F.lit("")), "_ru": _other(_source(segments), translated)})
    caption = (F.col("kind") == "paragraph") & F.col("_en").rlike(CAPTION)
    return measured(texts.select("document_id", "id", "idx", "kind", "heading_level", "page_idx", F.col("_of").alias("of"), _extent(F.col("_en")).alias("en"), _extent(F.col("_ru")).alias("ru"), caption.alias("caption"), (F.coalesce("image", F.lit("")) != "").alias("stored")))


def _source(segments: DataFrame) -> Column:
    """A struct of a segment's texts."""
    return F.struct(F.col("source_text").alias("en"), *(F.col(c).alias("ru") for c in ("translated_text",) if c in segments.columns))


def _other(texts: Column, translated: Callable[[Column], Column] | None) -> Column:
    """The translation, or the source where there is none."""
    ru = translated(texts["en"]) if translated else texts["ru"]
    return F.when(F.coalesce(ru, F.lit("")) != "", ru).otherwise(F.coalesce(texts["en"], F.lit("")))


def _extent(text: Column) -> Column:
    """Characters of a text, and of the white space at its start and end; a blank text is all both."""
    n, none = F.char_length(text), F.lit(0)
    lead = F.when(F.left(text, F.lit(1)).rlike(SPACE), n - F.char_length(F.regexp_replace(text, rf"^{SPACE}+", ""))).otherwise(none)
    trail = F.when(F.right(text, F.lit(1)).rlike(SPACE), n - F.char_length(F.regexp_replace(text, rf"{SPACE}+$", ""))).otherwise(none)
    return F.struct(n.alias("n"), lead.alias("lead"), trail.alias("trail"))


def _joined_length(extents: Column) -> Column:
    """Characters of the ``stripped`` lines that texts of these extents make."""

    def step(acc: Column, x: Column) -> Column:
        blank = x["lead"] == x["n"]
        upto = F.when(acc["begun"], acc["upto"] + 1 + x["n"]).otherwise(F.when(blank, 0).otherwise(x["n"] - x["lead"]))
        return F.struct((acc["begun"] | ~blank).alias("begun"), upto.cast("long").alias("upto"), F.when(blank, acc["length"]).otherwise(upto - x["trail"]).cast("long").alias("length"))

    start = F.struct(F.lit(False).alias("begun"), F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("length"))
    return F.aggregate(extents, start, step, lambda acc: acc["length"])


def numbered(rows: DataFrame) -> DataFrame:
    """``outlines`` numbered by ``nth`` in the order of each document."""
    return measured(running_in_parts(rows, ["document_id"], ["idx"], sums={"nth": F.lit(1).cast("long")}))


def text_key(segments: DataFrame) -> Column:
    """A hash that names a segment's texts: rows that share it have equal ones."""
    return _name(*(F.col(c) for c in ("document_id", "idx", "id", "source_text", "translated_text") if c in segments.columns))


def _name(*parts: Column) -> Column:
    """A hash of values, which may be null."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("-")) for x in parts))))


def _repeated(rows: DataFrame) -> bool:
    """Whether some of the ``outlines`` share a ``text_key``."""
    return not rows.groupBy("of").count().where("count > 1").isEmpty()


def texts_of(segments: DataFrame, repeated: bool) -> DataFrame:
    """(of, texts): one row for each ``text_key``, as they are read where none is repeated."""
    texts = segments.select(text_key(segments).alias("of"), _source(segments).alias("texts"))
    return texts.dropDuplicates(["of"]) if repeated else texts


def heading_paths(segments: DataFrame) -> DataFrame:
    """(document_id, idx, path): headings with the path they open.

    A heading of level n replaces everything from place n of the path on; a level that
    skips places leaves no holes.
    """
    rows = numbered(outlines(segments))
    heads = measured(_steps(rows).withColumn("section", F.monotonically_increasing_id()))
    return heads.join(_paths(heads, segments, _repeated(rows)), "section").select("document_id", "idx", "path")


def _steps(rows: DataFrame) -> DataFrame:
    """(document_id, idx, nth, steps) of the headings among ``numbered`` rows: the names of the texts that make the path.

    A heading's depth is the least of its level and one more than the depth before: its number less the running maximum of number - level. The path holds
    the last heading so far of every depth up to its own, found by a running maximum for each distinct depth.
    """
    heads = rows.where("kind = 'heading'").select("document_id", "idx", "nth", "of", F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)).alias("level"))
    heads = running_in_parts(heads, ["document_id"], ["nth"], sums={"number": F.lit(1).cast("long")})
    deep = running_in_parts(heads, ["document_id"], ["nth"], maxima={"over": F.col("number") - F.col("level")})
    deep = measured(deep.select("document_id", "idx", "nth", "of", (F.col("number") - F.greatest(F.col("over"), F.lit(0))).cast("int").alias("depth")))
    depths = sorted(r.depth for r in deep.select("depth").distinct().collect())
    last = {f"_at{d}": F.when(F.col("depth") == d, F.struct("nth", "of")) for d in depths}
    deep = running_in_parts(deep, ["document_id"], ["nth"], maxima=last)
    steps = F.array(*(F.when(F.col("depth") >= d, F.col(f"_at{d}")["of"]) for d in depths)) if depths else F.array().cast("array<binary>")
    return deep.select("document_id", "idx", "nth", F.slice(steps, F.lit(1), F.col("depth")).alias("steps"))


def _paths(sections: DataFrame, segments: DataFrame, repeated: bool) -> DataFrame:
    """(section, path): titles of the steps of (section, steps)."""
    titles = texts_of(segments.where("kind = 'heading'"), repeated).select("of", F.trim("texts.en").alias("title"))
    steps = sections.select("section", F.posexplode("steps").alias("place", "of"))
    # Dealt by section before they are gathered: else every task would sort texts to sum up what it has, and again those it gets.
    listed = steps.join(titles, "of").select("section", "place", "title").repartition("section")
    return listed.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("path")).select("section", F.transform("path", lambda x: x["title"]).alias("path"))


def _fill(most: int, least: int):
    """Rows sorted by document_id, stretch and nth get the number of their chunk within the stretch; nothing but the last row's state is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, held = None, 0, 0
        for batch in batches:
            parts = []
            for *mine, n in zip(*(batch.column(c).to_pylist() for c in ("document_id", "stretch", "n"))):
                if mine != key:
                    key, part, held = mine, 0, 0
                if held + n > most and held > least:
                    part, held = part + 1, 0
                held += n
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32())], names=[*batch.schema.names, "part"])

    return run


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys that may be null on both sides."""
    right = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    return left.join(right, on, how).drop(*(f"_r_{c}" for c in keys))


def chunked(segments: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS, translated: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of segments (document_id, id, idx, kind, heading_level, page_idx, source_text, translated_text, image).

    Text runs until a heading, an image or ``most`` characters; tables and images are chunks
    of their own, and a table does not end the text around it. Sections whose two texts
    together stay under half of ``least`` are left out; tables and images never are.
    Where a function of the source makes the translation (``translated``), segments need none, and it is made when a chunk's texts are together.

    Headings and images cut a document into stretches (a running count); a stretch's texts fill
    chunks in one pass over their lengths. Chunks are numbered by the place where each is complete. All of this is found on rows without
    texts, and by running sums over ranges: no task gathers a document. See ``written`` for the texts.
    """
    rows = numbered(outlines(segments, translated))
    return written(planned(rows, ["at", "later"], most, least), rows, segments, translated)


def planned(rows: DataFrame, order: list[str], most: int = MAX_CHARS, least: int = MIN_CHARS, also: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of ``numbered`` rows without their texts: chunk (a number of its own), document_id, idx, kind, under (nth of their heading), page_start, page_end and lines (nth, id, of, and ``also``) in order.

    Chunks are numbered by ``order``: the place where each is complete (at, later) or the least idx of its segments (first).
    """
    # Only a caption that follows an image is of use to it.
    captions = rows.where("caption").select("document_id", (F.col("nth") - 1).alias("nth"), F.col("of").alias("next_of"))
    image, table, own = F.col("kind") == "image", F.col("kind") == "table", F.col("en.lead") < F.col("en.n")
    shown = _joined(rows.where(image), captions, ["document_id", "nth"]).where(own | F.col("next_of").isNotNull() | F.col("stored"))
    shown = measured(shown.select("document_id", "nth", F.when(own, F.col("of")).otherwise(F.col("next_of")).alias("shown_of")))
    cuts = _joined(rows.select("document_id", "nth", "kind", F.col("en.n").alias("n")), shown.select("document_id", "nth", F.lit(True).alias("shown")), ["document_id", "nth"])
    cut = F.coalesce(F.col("shown") | (F.col("kind") == "heading"), F.col("kind") == "heading", F.lit(False))
    cuts = measured(running_in_parts(cuts, ["document_id"], ["nth"], sums={"stretch": cut.cast("long")}, maxima={"under": F.when(F.col("kind") == "heading", F.col("nth"))}))
    ends = cuts.groupBy("document_id", (F.col("stretch") - 1).alias("stretch")).agg(F.min("nth").alias("end"))

    texts = cuts.where(~F.col("kind").isin("table", "image")).select("document_id", "stretch", "nth", "n", "under")
    sorted_texts = texts.repartition("document_id", "stretch").sortWithinPartitions("document_id", "stretch", "nth")
    filled = measured(sorted_texts.mapInArrow(_fill(most, least), texts.withColumn("part", F.lit(0)).schema))
    firsts = measured(filled.groupBy("document_id", "stretch", "part").agg(F.min("nth").alias("first")))
    parts = _joined(firsts, firsts.select("document_id", "stretch", (F.col("part") - 1).alias("part"), F.col("first").alias("following")), ["document_id", "stretch", "part"])
    parts = _joined(parts, ends, ["document_id", "stretch"]).select("document_id", "stretch", "part", F.coalesce("following", "end", F.lit(LAST)).alias("at"))
    pieces = _joined(filled, parts, ["document_id", "stretch", "part"], "inner").select("document_id", "at", F.lit(0).alias("later"), F.lit("section").alias("chunk_kind"), "under", "nth")
    singles = cuts.where(table | F.coalesce("shown", F.lit(False))).select("document_id", F.col("nth").alias("at"), F.lit(1).alias("later"), F.col("kind").alias("chunk_kind"), "under", "nth")

    facts = _joined(rows.select("document_id", "nth", "id", "idx", "page_idx", "of", "en", "ru", image.alias("is_image"), *also), shown, ["document_id", "nth"])
    named = F.when(F.col("is_image"), F.col("shown_of")).otherwise(F.col("of"))
    facts = facts.select("document_id", "nth", "page_idx", F.struct("nth", "id", named.alias("of"), "idx", "en", "ru", *also).alias("line"))
    lines = F.array_sort(F.collect_list("line"))
    made = _joined(pieces.unionByName(singles), facts, ["document_id", "nth"], "inner").groupBy("document_id", "at", "later")
    made = made.agg(F.first("chunk_kind").alias("kind"), F.first("under").alias("under"), lines.alias("lines"), F.min("line.idx").alias("first"), F.min("page_idx").alias("page_start"), F.max("page_idx").alias("page_end"))
    # Empty sources leave no line, empty translations do.
    en = F.filter(F.transform("lines", lambda x: x["en"]), lambda x: x["n"] > 0)
    length = _joined_length(en) + _joined_length(F.transform("lines", lambda x: x["ru"]))
    made = made.where((F.col("kind") != "section") | (length >= least // 2))
    made = made.withColumn("lines", F.transform("lines", lambda x: F.struct(*(x[c].alias(c) for c in ("nth", "id", "of", *also)))))
    made = measured(made.withColumn("chunk", F.monotonically_increasing_id()))
    number = running_in_parts(made.select("document_id", *order, "chunk"), ["document_id"], order, sums={"number": F.lit(1).cast("long")})
    return measured(made.drop("at", "later", "first").join(number.select("chunk", (F.col("number") - 1).cast("int").alias("idx")), "chunk"))


#: Chunks of a section that are written together with one copy of their heading's path.
SECTION_CHUNKS = 64


def written(chunks: DataFrame, rows: DataFrame, segments: DataFrame, translated: Callable[[Column], Column] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """``planned`` chunks with their texts and heading paths, and with their columns ``more``.

    Texts are moved twice and never stored between: to the rows that say where they belong, and to the others of their section, or of its next ``SECTION_CHUNKS``
    chunks, where the section's path meets them. All else of a chunk goes along with its first text.
    """
    chunks = chunks.withColumn("section", _name(F.col("document_id"), F.col("under"), F.floor(F.col("idx") / SECTION_CHUNKS)))
    about = F.struct("document_id", "idx", "kind", "page_start", "page_end", F.col("lines.id").alias("segment_ids"), *more)
    places = chunks.select("section", "chunk", about.alias("about"), F.posexplode("lines").alias("n", "line")).select("section", "chunk", "n", F.when(F.col("n") == 0, F.col("about")).alias("about"), F.col("line.of").alias("of"))
    repeated = _repeated(rows)
    texts = texts_of(segments, repeated)
    # An image that is only stored has no text.
    without = places.where("of is null").drop("of").withColumn("texts", F.lit(None).cast(texts.schema["texts"].dataType))
    pieces = places.where("of is not null").join(texts, "of").drop("of").unionByName(without).repartition("section")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "texts"))), lambda x: x["texts"])
    made = pieces.groupBy("section", "chunk").agg(lines.alias("lines"), F.first("about", ignorenulls=True).alias("about")).select("section", "about.*", "lines")

    section, table = F.col("kind") == "section", F.col("kind") == "table"
    only, empty = F.col("lines")[0], lambda c: F.coalesce(c, F.lit(""))
    en = F.when(section, F.array_join(F.filter(F.transform("lines", lambda x: empty(x["en"])), lambda t: t != ""), "\n")).when(table, empty(only["en"])).otherwise(only["en"])
    ru = translated(only["en"]) if translated else only["ru"]
    ru = F.when(section, F.array_join(F.transform("lines", lambda x: _other(x, translated)), "\n")).when(table, _other(only, translated)).otherwise(F.coalesce(F.nullif(ru, F.lit("")), only["en"]))
    made = made.withColumns({"en": en, "ru": ru}).drop("lines")
    page = F.coalesce("page_start", F.lit(0)) + 1
    # Only an image may have no text.
    text_en = F.coalesce(stripped(F.col("en")), F.concat(F.lit("Figure (page "), page, F.lit(")")))
    text_ru = F.coalesce(stripped(F.col("ru")), F.concat(F.lit("Рисунок (стр. "), page, F.lit(")")))

    opened = chunks.where("under is not null").select("document_id", F.col("under").alias("nth"), "section").distinct()
    opened = _joined(opened, _steps(rows).select("document_id", "nth", "steps"), ["document_id", "nth"], "inner").select("section", "steps")
    led = made.join(_paths(opened, segments, repeated), "section", "left")
    path = F.coalesce("path", F.array().cast("array<string>"))
    path = F.when(table, F.concat(path, F.array(F.lit(TABLE_STEP)))).otherwise(path)
    return led.select("document_id", "idx", "kind", F.array_join(path, ARROW).alias("heading_path"), text_en.alias("text_en"), text_ru.alias("text_ru"), "page_start", "page_end", "segment_ids", *more)


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    # Few texts have any: the others aren't searched.
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(SPACE), F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")).otherwise(text)


def bounded_parts(text: Column, limit: int) -> Column:
    """A text in parts of at most ``limit`` characters: cut at the last blank within them, unless that lies in the first third.

    A fold over words: each goes on with the part before it if it fits; a word that doesn't fit beside a short part is cut.
    """
    words = F.filter(F.split(text, " +"), lambda w: w != "")
    start = F.expr("cast(array() as array<string>)")

    def step(acc: Column, w: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        joined = F.when(last == "", w).otherwise(F.concat(last, F.lit(" "), w))
        short = F.char_length(last) < limit // 3
        pieces = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(t) / limit).cast("int") - 1, F.lit(0))), lambda i: F.trim(F.substring(t, i * limit + 1, F.lit(limit))))
        return F.when(F.char_length(joined) <= limit, F.concat(head, F.array(joined))).when(short, F.concat(head, pieces(joined))).otherwise(F.concat(acc, pieces(w)))

    return F.aggregate(words, start, step)


def deduplicated(ranked: DataFrame, protected: int = 0) -> DataFrame:
    """Rows (query_id, position, id, document_id, segment_ids) less repeats of an id and rows whose segments were all seen before.

    The first ``protected`` positions are only checked for repeated ids. A query's list is
    bounded by its top-k; lists are independent.
    """
    names = [f.name for f in ranked.schema]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, seen, keep = set(), {}, []
        for i, row in enumerate(pdf.sort_values("position").to_dict("records")):
            mine = {str(s) for s in (row["segment_ids"] if row["segment_ids"] is not None else []) if s}
            known = seen.setdefault(row["document_id"], set())
            if row["id"] in ids or (i >= protected and mine and mine <= known):
                continue
            ids.add(row["id"])
            known |= mine
            keep.append(row)
        return pd.DataFrame(keep, columns=names)

    return ranked.groupBy("query_id").applyInPandas(one, ranked.schema)
