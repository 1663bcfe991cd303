"""Parsed pages: quality scores, page types, routes, backfill and replacement of segments.

Segments are (document_id, idx, kind, page_idx, source_text ...); every operator aggregates
by document and page before rows of one document meet, so that a document with very many
segments is no group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r\f\x0B]+"
#: Weights of page coverage, content coverage, density, freedom from duplicates and integrity; fixed values.
WEIGHTS = (0.35, 0.10, 0.25, 0.15, 0.15)
STRUCTURED = ("image", "table", "equation")
#: Roles of pages that don't stay with the primary parser, first come first; fixed values.
ROLES = ("structured_extraction", "chart_extraction", "diagram_extraction", "parser_fallback")


def plain(text: Column) -> Column:
    """Single spaces for white space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def degenerate(text: Column) -> Column:
    """A text of 40 characters or more that is one character for over 80 %, over 8000 long, or of 60 words or more of which under 35 % differ."""
    t = plain(text)
    body = F.replace(t, F.lit(" "), F.lit(""))
    # A character of over 80 % of 20 or more stands three times in a row somewhere: only such ones are counted.
    tripled = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?s)(.)\1\1"), F.lit(1)))
    top = F.coalesce(F.array_max(F.transform(tripled, lambda c: F.char_length(body) - F.char_length(F.replace(body, c, F.lit(""))))), F.lit(0))
    words = F.split(F.lower(t), " ")
    few = (F.size(words) >= 60) & (F.size(F.array_distinct(words)) < 0.35 * F.size(words))
    return (F.char_length(t) >= 40) & ((top > 0.8 * F.char_length(body)) | (F.char_length(t) > 8000) | few)


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Four finite coordinates, ends beyond starts, within the page where its size is given; null coordinates are invalid."""
    finite = F.lit(True)
    for c in (x0, y0, x1, y1):
        finite = finite & c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    good = finite & (x1 > x0) & (y1 > y0)
    if width is not None:
        good = good & (x0 >= 0) & (y0 >= 0) & (x1 <= width) & (y1 <= height)
    return F.coalesce(good, F.lit(False))


def doubled_characters(segments: DataFrame) -> DataFrame:
    """(document_id, ratio): of neighbouring letters and digits, case aside, the share of equal ones."""
    letters = F.regexp_replace(F.lower(F.coalesce("source_text", F.lit(""))), r"[^\p{L}\p{N}]+", "")
    # A letter and the same letter after it, at every place: what stays of the text without its last letter.
    same = F.regexp_count(letters, F.lit(r"(.)(?=\1)"))
    pairs = F.greatest(F.char_length(letters) - 1, F.lit(0))
    total = segments.groupBy("document_id").agg(F.sum(same).alias("same"), F.sum(pairs).alias("pairs"))
    return total.select("document_id", F.when(F.col("pairs") > 0, F.round(F.col("same") / F.col("pairs"), 6)).otherwise(0.0).alias("ratio"))


def page_counts(segments: DataFrame) -> DataFrame:
    """(document_id, page_idx, segments, text_chars, structured)."""
    return segments.groupBy("document_id", "page_idx").agg(
        F.count("*").alias("segments"), F.sum(F.char_length(plain(F.col("source_text")))).alias("text_chars"), F.max(F.col("kind").isin(*STRUCTURED)).alias("structured")
    )


def parse_quality(segments: DataFrame, sizes: DataFrame, native: DataFrame, least: float = 0.7) -> DataFrame:
    """Score, acceptance and reasons of each document's parse.

    ``sizes`` has (document_id, n_pages), ``native`` (document_id, native_chars). Segments have the
    numbers of structures ``checked`` and ``broken`` among them. Coverage is by pages with segments and by pages with content;
    density is text against 40 characters a page, averaged with native coverage where known; duplicates are
    by characters of equal texts of 20 characters or more.
    """
    pages = segments.groupBy("document_id", "page_idx").agg(
        F.sum(F.char_length(plain(F.col("source_text")))).alias("text_chars"), F.max(F.col("kind").isin(*STRUCTURED)).alias("structured"),
        F.count("*").alias("n"), F.sum("broken").alias("broken"), F.sum("checked").alias("checked"),
    ).join(sizes, "document_id")
    inside = F.col("page_idx").isNotNull() & (F.col("page_idx") >= 0) & (F.col("page_idx") < F.col("n_pages"))
    outside = F.col("page_idx").isNotNull() & ~inside
    per = pages.groupBy("document_id", "n_pages").agg(
        F.sum("n").alias("n"), F.count_if(inside).alias("covered"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("invalid"),
        F.count_if(inside & ((F.col("text_chars") > 0) | F.col("structured"))).alias("content"), F.count_if(inside & (F.col("text_chars") > 0)).alias("texts"),
        F.sum(F.when(inside, F.col("text_chars")).otherwise(0)).alias("chars"), F.max(inside & F.col("structured")).alias("structured"), F.sum("broken").alias("broken"), F.sum("checked").alias("checked"),
    )
    text = plain(F.col("source_text"))
    same = segments.select("document_id", F.md5(text).alias("m"), F.char_length(text).alias("len")).where("len >= 20").groupBy("document_id", "m", "len").count()
    repeated = same.groupBy("document_id").agg((F.sum(F.col("len") * (F.col("count") - 1)) / F.sum(F.col("len") * F.col("count"))).alias("duplicates"))
    all_of = sizes.join(per.drop("n_pages"), "document_id", "left").join(repeated, "document_id", "left").join(native, "document_id", "left").na.fill(0)
    n_pages, n = F.col("n_pages"), F.col("n")
    page_coverage = F.when(n_pages == 0, 1.0).otherwise(F.col("covered") / n_pages)
    content_coverage = F.when(n_pages == 0, 1.0).otherwise(F.col("content") / n_pages)
    density = F.when((F.col("chars") == 0) & F.coalesce("structured", F.lit(False)), 0.5).otherwise(F.least(F.lit(1.0), F.col("chars") / (40 * F.greatest(F.col("texts"), F.lit(1)))))
    integrity = F.when(F.col("checked") > 0, 1 - F.col("broken") / F.col("checked")).otherwise(1.0)
    integrity = F.when(F.col("invalid") > 0, integrity * F.greatest(F.lit(0.0), 1 - F.col("invalid") / F.greatest(n, F.lit(1)))).otherwise(integrity)
    native_coverage = F.when(F.col("native_chars") > 0, F.least(F.lit(1.0), F.col("chars") / F.col("native_chars")))
    signal = F.coalesce((density + native_coverage) / 2, density)
    parts = (page_coverage, content_coverage, signal, 1 - F.col("duplicates"), integrity)
    score = F.when(n == 0, 0.0).otherwise(F.round(sum(w * x for w, x in zip(WEIGHTS, parts)), 4))
    reasons = F.array_compact(F.array(
        F.when(n == 0, F.lit("empty_output")), F.when(page_coverage < 1, F.lit("missing_pages")), F.when(F.col("invalid") > 0, F.lit("invalid_page_indices")), F.when((n > 0) & (content_coverage < 1), F.lit("pages_without_content")),
        F.when((n > 0) & (density < 0.5), F.lit("sparse_text")), F.when(F.col("duplicates") > 0.25, F.lit("duplicate_content")), F.when(F.col("broken") > 0, F.lit("invalid_structures")), F.when(native_coverage < 0.5, F.lit("low_native_text_coverage")),
    ))
    out = all_of.select("document_id", score.alias("score"), F.round(page_coverage, 4).alias("page_coverage"), F.round("duplicates", 4).alias("duplicate_ratio"), F.round(integrity, 4).alias("integrity_ratio"), F.round(native_coverage, 4).alias("native_text_coverage"), reasons.alias("reasons"))
    return out.withColumn("acceptable", (F.col("score") >= least) & (F.size(F.array_remove("reasons", "sparse_text")) == 0))


def page_types(pages: DataFrame) -> DataFrame:
    """page_type and confidence from counts by page: images, tables, equations, texts, parsed_chars, native_chars, fields, marks and the hints form, chart, diagram."""
    c = F.col
    form = (c("form") & (c("fields") + c("marks") >= 1)) | (c("fields") >= 4) | (c("marks") >= 3)
    image, prose = c("images") > 0, (c("texts") > 0) | (c("parsed_chars") >= 80)
    kinds = sum((c(k) > 0).cast("int") for k in ("tables", "images", "equations"))
    rules = [
        (form, "form", 0.92), (image & c("chart") & c("diagram"), "mixed", 0.78), (image & c("chart"), "chart", 0.90), (image & c("diagram"), "diagram", 0.90), ((kinds >= 2) & prose, "mixed", 0.78),
        (c("tables") > 0, "table", 0.90), ((c("equations") > 0) & (c("texts") > 0), "mixed", 0.72), (image & prose, "mixed", 0.70), ((c("native_chars") < 20) & (c("parsed_chars") >= 40) & ~image, "scan", 0.80),
        ((c("parsed_chars") >= 40) & (c("native_chars") > 0), "text", 0.85), (c("parsed_chars") >= 40, "text", 0.75), (c("native_chars") >= 40, "text", 0.65),
    ]
    kind, sure = F, F
    for condition, name, confidence in rules:
        kind, sure = kind.when(condition, F.lit(name)), sure.when(condition, F.lit(confidence))
    return pages.withColumns({"page_type": kind.otherwise("unknown"), "confidence": sure.otherwise(0.0)})


def page_routes(pages: DataFrame, least: float = 0.7) -> DataFrame:
    """role and reason from page_type, raw_score, backfilled and explicit."""
    kind = F.col("page_type")
    rules = [
        (F.col("explicit"), "primary", "explicit_backend"), (kind == "form", "structured_extraction", "form_requires_schema_extraction"), (kind == "chart", "chart_extraction", "chart_requires_data_extraction"),
        (kind == "diagram", "diagram_extraction", "diagram_requires_structured_representation"), (kind == "table", "parser_fallback", "table_requires_structure_check"),
        (F.col("raw_score") < least, "parser_fallback", "low_raw_score"), (F.col("backfilled"), "parser_fallback", "backfilled_primary"),
    ]
    role, reason = F, F
    for condition, r, why in rules:
        role, reason = role.when(condition, F.lit(r)), reason.when(condition, F.lit(why))
    return pages.withColumns({"role": role.otherwise("primary"), "reason": reason.otherwise("primary_acceptable")})


def routing_plan(routes: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pages of each document that leave the primary parser, by role, then page."""
    priority = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role"))
    order = Window.partitionBy("document_id").orderBy("priority", "page_idx")
    return routes.where("role <> 'primary'").withColumn("priority", priority).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("priority")


def backfilled(segments: DataFrame, layer: DataFrame, key: Column, layer_key: Column, cover: float = 0.6, least: int = 200, prefix: int = 48) -> DataFrame:
    """(document_id, page_idx, paragraph, text): paragraphs of the text layer that a thin page lacks.

    A page is thin where its layer has ``least`` characters or more and the segments under ``cover`` of
    them. A paragraph is lacking where the first ``prefix`` characters of its key occur in none of the page's segments.
    ``layer`` has (document_id, page_idx, paragraph, text).
    """
    got = segments.groupBy("document_id", "page_idx").agg(F.sum(F.char_length(F.coalesce("source_text", F.lit("")))).alias("got"))
    size = layer.groupBy("document_id", "page_idx").agg(F.sum(F.char_length("text")).alias("size"))
    thin = size.join(got, ["document_id", "page_idx"], "left").where((F.col("size") >= least) & (F.coalesce("got", F.lit(0)) < cover * F.col("size"))).select("document_id", "page_idx")
    wanted = layer.join(thin, ["document_id", "page_idx"]).withColumn("k", F.substring(layer_key, 1, prefix))
    held = segments.select("document_id", "page_idx", key.alias("held")).where("held <> ''")
    return wanted.where("k <> ''").join(held, (wanted.document_id == held.document_id) & (wanted.page_idx == held.page_idx) & held.held.contains(wanted.k), "left_anti").drop("k")


def replaced_pages(primary: DataFrame, candidates: DataFrame) -> DataFrame:
    """Segments of the primary parser, whole pages of which are those of the candidates where these have the page; numbered anew."""
    pages = candidates.select("document_id", "page_idx").distinct()
    kept = primary.join(pages, ["document_id", "page_idx"], "left_anti")
    order = Window.partitionBy("document_id").orderBy(F.col("page_idx").asc_nulls_last(), "idx")
    return kept.unionByName(candidates).withColumn("new_idx", F.row_number().over(order) - 1)


def fallback_choice(pages: DataFrame, least: float, margin: float) -> DataFrame:
    """choice and reason by page from primary_score, fallback_score, primary_chars and fallback_chars."""
    p, f = F.col("primary_score"), F.col("fallback_score")
    reason = F.when(f.isNull(), "no_candidate").when(f < least, "below_minimum").when(F.round(f - p, 9) < margin, "margin_not_met").when(F.col("fallback_chars") < F.col("primary_chars"), "text_regression").otherwise("better")
    return pages.withColumn("reason", reason).withColumn("choice", F.when(F.col("reason") == "better", "fallback").otherwise("primary"))


def capped(text: Column, most: int) -> Column:
    """A paragraph as parts of at most ``most`` characters, filled with whole lines or else sentences; longer ones are cut."""
    lines = text.contains("\n")
    units = F.when(lines, F.split(text, "\n")).otherwise(F.split(text, r"(?<=[.!?])[ \t\n\r\f\x0B]+"))
    sep = F.when(lines, F.lit("\n")).otherwise(F.lit(" "))
    # Each unit is cut first; a piece of full length stands alone, as nothing fits beside it.
    pieces = F.flatten(F.transform(units, lambda u: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(u) / most) - 1, F.lit(0))), lambda i: F.substring(u, (i * most + 1).cast("int"), F.lit(most)))))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, u: Column) -> Column:
        fits = (acc["buf"] == "") | (F.char_length(acc["buf"]) + F.char_length(u) <= most)
        joined = F.when(acc["buf"] == "", u).otherwise(F.concat(acc["buf"], sep, u))
        return F.struct(F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.trim(acc["buf"])))).alias("out"), F.when(fits, joined).otherwise(u).alias("buf"))

    done = F.aggregate(pieces, start, step, lambda acc: F.concat(acc["out"], F.array(F.trim(acc["buf"]))))
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(F.filter(done, lambda x: x != ""))


def joined(lines: Column, clause: str) -> Column:
    """Lines as paragraphs: one that begins a clause begins one, all others go on with the last.

    Lines hold no line end, so that one marks the paragraphs in a single string that is then split: linear in the text's length.
    """
    marked = F.transform(lines, lambda x, i: F.when((i > 0) & x.rlike(clause), F.concat(F.lit("\n"), x)).otherwise(x))
    return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(F.split(F.array_join(marked, " "), " \n"))


def paragraphs(text: Column, clause: str) -> Column:
    """Lines of a page as paragraphs: a line that begins a clause begins one, all others go on with the last."""
    return joined(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", "")), lambda x: x != ""), clause)


# How clauses begin, entries of contents end and page numbers look.
CLAUSE_START = r"^\s*(\d+\.(?:\d+)*\s|\([a-z0-9]{1,4}\)\s|[A-Z][A-Za-z ]{1,28}:\s)"
CONTENTS_ENTRY = r"[.…]{3,}\s*\d+\s*$"
PAGE_NUMBER = "^[ivxlcdm0-9]{1,6}$"


def page_paragraphs(page: Column, most: int | None = 1800) -> Column:
    """A page's text layer as paragraphs of at most ``most`` characters; null and blank pages have none.

    A page of contents (three entries or more, two fifths of its lines) is one paragraph of its lines, leaders
    shortened. A first line that is a page number goes.
    """
    lines = F.split(F.replace(F.coalesce(page, F.lit("")), F.lit("\r")), "\n")
    lines = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    entries = F.size(F.filter(lines, lambda x: x.rlike(CONTENTS_ENTRY)))
    contents = F.array(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "[.…]{2,}", " … ")), "\n"))
    numbered = F.coalesce(F.lower(F.get(lines, F.lit(0))).rlike(PAGE_NUMBER), F.lit(False))
    body = F.when(numbered, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    found = F.when(entries >= F.greatest(F.lit(3.0), F.size(lines) * F.lit(0.4)), contents).otherwise(joined(body, CLAUSE_START))
    return found if most is None else F.flatten(F.transform(found, lambda p: capped(p, most)))


def content_segments(items: DataFrame) -> DataFrame:
    """Segments from a parser's items (document_id, position, type, text, text_level, page_idx, caption).

    Text with a level is a heading, other text a paragraph; a header stays, as a heading of level 1 at
    the beginning of its page, where its normalised text is its document's only one; footers go. Tables need a caption or a
    body, images none. Degenerate paragraphs and tables are left out.
    """
    text = plain(F.col("text"))
    headers = items.where("type = 'header'").groupBy("document_id", F.lower(text).alias("norm")).agg(F.count("*").alias("times"))
    rows = items.withColumn("norm", F.lower(text)).join(headers, ["document_id", "norm"], "left").withColumn("t", text)
    kind = (
        F.when((F.col("type") == "text") & (F.col("t") != ""), F.when(F.coalesce("text_level", F.lit(0)) > 0, "heading").otherwise("paragraph"))
        .when((F.col("type") == "header") & (F.col("t") != "") & (F.col("times") == 1), "heading")
        .when((F.col("type") == "table") & ((F.col("t") != "") | (F.coalesce("caption", F.lit("")) != "")), "table")
        .when(F.col("type") == "image", "image")
        .when((F.col("type") == "equation") & (F.col("t") != ""), "equation")
    )
    body = F.when(F.col("type") == "image", F.coalesce("caption", F.lit(""))).when(F.col("type") == "table", F.trim(F.concat_ws("\n", F.col("caption"), F.col("t")))).otherwise(F.col("t"))
    level = F.when(F.col("type") == "header", 1).when(F.col("type") == "text", F.when(F.col("text_level") > 0, F.col("text_level")))
    made = rows.withColumns({"kind": kind, "source_text": body, "heading_level": level, "title": F.col("type") == "header"}).where("kind is not null")
    return made.where(~(F.col("kind").isin("paragraph", "table") & degenerate(F.col("source_text")))).select("document_id", "position", "kind", "source_text", "heading_level", "page_idx", "title")
