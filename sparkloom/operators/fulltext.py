"""Full text search with phrases, alternatives and exclusions, in one pass over the texts.

A query is read as web searches are: words and "quoted phrases" must all occur, ``or`` separates alternatives
and a leading minus excludes. Words are lower-cased and cut to stems in several configurations at once; a document matches
where it does in any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept
from .lexical import tokens

#: How many units of queries are broadcast (some 500 bytes each, with their literals).
BROADCAST_UNITS = 100_000
#: Endings that a configuration cuts from words of five letters or more.
ENDINGS = {"english": "(ing|edly|ed|es|s|ly)$", "russian": "(иями|ями|ами|ого|его|ому|ему|ыми|ими|ах|ях|ов|ев|ей|ой|ый|ий|ая|яя|ое|ее|ые|ие|ом|ем|ам|ям|а|я|о|е|ы|и|у|ю|ь)$"}


def stems(words: Column, ending: str) -> Column:
    """Words of an array without the ending."""
    return F.transform(words, lambda w: F.when(F.char_length(w) >= 5, F.regexp_replace(w, ending, "")).otherwise(w))


def literals(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, alternative, literal, negated, words): what each query asks for, words lower-cased; literals without a word are left out."""
    parts = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))
    rows = queries.select(F.col(id_col).alias("query_id"), F.posexplode(parts).alias("literal", "said"))
    either = F.lower("said") == "or"
    so_far = Window.partitionBy("query_id").orderBy("literal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("alternative", F.count_if(either).over(so_far)).where(~either)
    return rows.select("query_id", "alternative", "literal", F.col("said").startswith("-").alias("negated"), tokens(F.col("said")).alias("words")).where(F.size("words") > 0)


def pattern(forms: Column) -> Column:
    """An expression that finds a literal in words between single spaces, at each place where it begins; ``forms`` holds the words that may stand at each of its own.

    Words are letters and digits only. A literal with a word that no text has is never found.
    """
    said = F.array_join(F.transform(forms, lambda x: F.concat(F.lit("(?:"), F.array_join(x, "|"), F.lit(")"))), " ")
    return F.when(F.exists(forms, lambda x: F.size(x) == 0), F.lit("(?!)")).otherwise(F.concat(F.lit("(?= "), said, F.lit(" )")))


def matches(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int, endings: dict[str, str] = ENDINGS) -> DataFrame:
    """(query_id, id, rank, score): the k best matches of every query; ties by id.

    A document's score is the sum of ln(1 + occurrences) over the literals of its best alternative and configuration. An alternative of
    exclusions only matches every document without them. Each alternative is looked for by its rarest unit, a word or two neighbours of a phrase, as
    estimated from the words' counts: where the unit is among a text's own, all literals are counted in that text at once. The units are
    broadcast, so that no posting leaves the scan's stage, only matches do; more than BROADCAST_UNITS are joined by a shuffle of the texts' units.
    """
    key = ["config", "query_id", "alternative"]
    asked = None
    for name, ending in endings.items():
        one = literals(queries, query_id, query_text).select(F.lit(name).alias("config"), "query_id", "alternative", "literal", "negated", stems(F.col("words"), ending).alias("words"))
        asked = one if asked is None else asked.unionByName(one)
    asked = kept(asked)
    cut = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    # explode_outer: explode would have texts cut into words once more by a filter of its own. Distinct words of all texts are cut to stems, not every word of every text.
    vocabulary = cut.select(F.explode_outer("w").alias("raw")).groupBy("raw").agg(F.count("*").alias("times"))
    vocabulary = vocabulary.withColumn("s", F.explode(F.array(*(F.struct(F.lit(name).alias("config"), F.get(stems(F.array("raw"), ending), F.lit(0)).alias("word")) for name, ending in endings.items()))))
    wanted = asked.select("config", F.explode("words").alias("word")).distinct()
    forms = kept(vocabulary.select("raw", "times", "s.*").join(wanted, ["config", "word"]).groupBy("config", "word").agg(F.collect_list("raw").alias("raws"), F.sum("times").alias("often")))
    places = asked.select(*key, "literal", "negated", F.posexplode("words").alias("place", "word")).join(forms, ["config", "word"], "left")
    raws = F.coalesce("raws", F.array().cast("array<string>"))
    said = places.groupBy(*key, "literal", "negated").agg(F.array_sort(F.collect_list(F.struct("place", raws.alias("raws"))))["raws"].alias("forms"))
    said = said.select(*key, "negated", pattern(F.col("forms")).alias("pattern"))
    alternatives = kept(said.groupBy(*key).agg(F.collect_list(F.struct("negated", "pattern")).alias("literals"), F.every("negated").alias("free")))
    # Units: words, or two neighbours, which stand together about as often as chance would have it.
    following = F.arrays_zip(F.col("words").alias("word"), F.slice("words", F.lit(2), F.size("words")).alias("next"))
    units = asked.where("not negated").select(*key, F.inline(following)).join(forms.withColumnRenamed("raws", "first"), ["config", "word"], "left")
    units = units.join(forms.select("config", F.col("word").alias("next"), F.col("raws").alias("second"), F.col("often").alias("others")), ["config", "next"], "left")
    units = units.join(F.broadcast(forms.agg(F.sum("often").alias("total"))))  # one row
    chance = F.coalesce(F.col("often") * F.when(F.col("next").isNull(), 1.0).otherwise(F.col("others") / F.col("total")), F.lit(0.0))
    rarest = units.groupBy(*key).agg(F.min_by(F.struct(F.col("next").isNull().alias("single"), "first", "second"), chance).alias("u")).select(*key, "u.*")
    second = F.when(F.col("single"), F.array(F.lit(""))).otherwise(F.transform("second", lambda x: F.concat(F.lit(" "), x)))
    looked_for = kept(rarest.select(*key, "single", F.explode("first").alias("a"), second.alias("second")).select(*key, "single", "a", F.explode("second").alias("b")).select(*key, "single", F.concat("a", "b").alias("unit")))
    listed = F.collect_list(F.struct("query_id", "literals")).alias("alternatives")
    keys = looked_for.select(*key, "unit").join(alternatives.drop("free"), key).groupBy("unit").agg(listed)
    n, singles = looked_for.agg(F.count("*"), F.count_if("single")).first()
    own = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.size("w")), lambda x, y: F.concat(x, F.lit(" "), y))
    own = F.array_distinct(F.concat("w", own) if singles else own).alias("own")
    spaced = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("text")
    if n <= BROADCAST_UNITS:
        drawn = cut.select("id", spaced, own).select("id", "text", F.explode_outer("own").alias("unit")).join(F.broadcast(keys), "unit")
    else:
        drawn = cut.select("id", own).select("id", F.explode_outer("own").alias("unit")).join(keys, "unit").join(cut.select("id", spaced), "id")
    drawn = drawn.select("id", "text", "alternatives")
    free = alternatives.where("free")
    if not free.isEmpty():  # nearly the whole table is the answer of such a query
        drawn = drawn.unionByName(cut.select("id", spaced).crossJoin(free.agg(listed)))
    good = F.filter("alternatives", lambda a: F.forall(a["literals"], lambda x: F.rlike("text", x["pattern"]) != x["negated"]))
    times = lambda x: F.when(x["negated"], 0).otherwise(F.regexp_count("text", x["pattern"]))
    scored = F.transform(good, lambda a: F.struct(a["query_id"].alias("query_id"), F.aggregate(a["literals"], F.lit(0.0), lambda s, x: s + F.log1p(times(x))).alias("score")))
    # Chosen within the array: as a filter the choice would become a condition of the join, met by every unit of every text.
    found = drawn.select("id", F.inline_outer(scored)).where("query_id is not null")
    best = found.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")
