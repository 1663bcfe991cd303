"""Operator 5, benchmark decontamination: a broadcast hash set of test n-grams.

Words: A-Z lower-cased, runs of digits, letters and any non-ASCII characters. A test item's
windows are its runs of 13 words (all of them where it has fewer). Documents are read and
split once: every position's window is hashed inside the scan's own stage and looked up in
the hash set, and only matches, verified word by word in the same place, leave it, besides
one row a document with its number of words. Spans that overlap are joined by their ends
before they are counted.

Scale: documents are never shuffled; hits are, by document. Both sides are split and
lower-cased by one function, character by character, so that no neighbour changes a word. At most
``BROADCAST_WINDOWS`` windows are broadcast at once; a larger benchmark is cut by hash
into that many parts, and the documents are scanned once for each.

Defined cases: null and word-less texts have no words, no hits; null ids of items are the
item "null"; equal windows of several items count for each; repeated item rows count once;
rows are told apart by id (null is an id like any other) and a
hash of their text, so that rows that share an id are judged each by its own text and equal rows share one result; an
empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 13
SHARE = 20
#: Windows of the benchmark that are broadcast at once (some 150 bytes each).
BROADCAST_WINDOWS = 500_000
#: What separates words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + APART, LOWER + " " * len(APART))
    return F.array_remove(F.split(plain, " "), "")


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, n, gram): the distinct windows of every item, n words joined by a space."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at")
    return items.select("item", "n", "w", at).select("item", "n", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("gram")).distinct()


def row_key(text: Column) -> Column:
    """What tells rows of one id apart, made where the text is read."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same_row(other_id: str, other_row: str) -> Column:
    """Join condition of (doc_id, row) with another frame's, null ids included."""
    return F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col("row") == F.col(other_row))


def hit_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, row, at, n, gram, n_words): every occurrence of a test window, ``at`` counting words from 0; ``row`` is the text's ``row_key``.

    Each document also has a row with n = 0, for its number of words.
    """
    grams = windows.select("n", "gram").distinct()
    lengths, count = grams.agg(F.collect_set("n"), F.count("*")).first()  # at most WINDOW lengths
    lengths = sorted(lengths)
    grams = grams.withColumn("key", F.xxhash64("n", F.split("gram", " ")))
    low = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("row"), words_of(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w"))

    def occurrences(part: DataFrame, counted: bool) -> DataFrame:
        places = F.sequence(F.lit(0), F.col("n_words") - lengths[0]) if lengths else F.array().cast("array<int>")
        places = F.when(F.col("n_words") >= (lengths or [0])[0], places).otherwise(F.array().cast("array<int>"))
        if counted:  # place -1 is the row for the number of words: no words, found by the empty window
            places = F.concat(F.array(F.lit(-1)), places)
            none = part.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit("").alias("gram"), F.xxhash64(F.lit(0), F.array().cast("array<string>")).alias("key"))
            part = part.unionByName(none)
        rows = low.select("doc_id", "row", "w", "n_words", F.explode(places).alias("at"))
        of_place = F.when(F.col("at") < 0, F.array(F.lit(0))).otherwise(F.array(*(F.lit(n) for n in lengths or [0])))
        if len(lengths) > 1:
            rows = rows.withColumn("l", F.explode(of_place)).where("at + l <= n_words")
        else:
            rows = rows.withColumn("l", F.when(F.col("at") < 0, 0).otherwise((lengths or [0])[0]))
        window = F.slice("w", F.greatest(F.col("at") + 1, F.lit(1)), F.col("l"))
        found = rows.withColumn("key", F.xxhash64("l", window)).join(F.broadcast(part), "key")
        return found.where((F.col("l") == F.col("n")) & (F.array_join(window, " ") == F.col("gram"))).select("doc_id", "row", "at", "n", "gram", "n_words")

    parts = max(1, -(-count // at_once))
    if parts == 1:
        return occurrences(grams, True)
    out = None
    for i in range(parts):
        one = occurrences(grams.where(F.pmod("key", F.lit(parts)) == i), i == 0)
        out = one if out is None else out.unionByName(one)
    return out


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = SHARE, at_once: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    windows = test_windows(benchmark, window)
    found = materialize(hit_windows(docs, windows, id_col, text_col, at_once), "hits")  # read thrice below
    hits = found.where("n > 0").select("doc_id", "row", "at", "n", "gram").distinct()
    before = Window.partitionBy("doc_id", "row").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    ends = hits.select("doc_id", "row", "at", "n").distinct().withColumn("covered", F.coalesce(F.max(F.col("at") + F.col("n")).over(before), F.lit(0)))
    new = F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest("at", "covered"))
    n_hit = ends.groupBy("doc_id", "row").agg(F.sum(new).alias("n_hit")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "n_hit")
    of = windows.select("n", "gram", "item")
    items = hits.select("doc_id", "row", "n", "gram").distinct().join(of, ["n", "gram"]).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged_rows = items.join(n_hit, same_row("_id", "_row")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "n_hit", "items")
    counts = found.where("n = 0").select("doc_id", "row", F.col("n_words").cast("long"))
    out = counts.join(judged_rows, same_row("_id", "_row"), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "row",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the contaminated rows; the columns and all other rows stay."""
    gone = judged(docs, benchmark, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (row_key(docs[text_col]) == gone["_row"]), "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose hit words are cut from the text, the other words and their separators kept."""
    windows = test_windows(benchmark)
    hits = hit_windows(docs, windows, id_col, text_col).where("n > 0").select("doc_id", "row", "at", "n").distinct()
    spans = hits.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "n")).alias("_spans")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_spans")
    marked = docs.join(spans, docs[id_col].eqNullSafe(spans["_id"]) & (row_key(docs[text_col]) == spans["_row"]), "left").drop("_id", "_row")
    # Each word with what precedes it; a word inside a span goes with its separator.
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?:{SEPARATORS})?{WORDS}"), F.lit(0))
    inside = lambda i: F.exists("_spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["n"]))
    kept = F.array_join(F.filter(pieces, lambda p, i: ~inside(i)), "")
    tail = F.regexp_extract(F.col(text_col), f"({SEPARATORS})$", 1)
    return marked.withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.concat(kept, tail))).drop("_spans")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM g),
p AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n),
h AS (SELECT DISTINCT p.rid, p.i, p.n, g.item FROM p JOIN g ON p.n = g.n AND array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ') = g.gram),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
