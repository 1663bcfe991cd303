"""Joins by containment and position: glossary terms, evidence, bindings, similar texts, quotas."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

#: Rows whose sketches a task holds, twice.
BLOCK = 4_096
WORD = r"[\p{L}\p{N}]+"


def glossary_terms(texts: DataFrame, terms: DataFrame, most: int = 10) -> DataFrame:
    """(id, term_id, term, place): at most ``most`` terms of each text (id, text), in the order of term_id.

    Case aside, a term (term_id, term) counts where its first occurrence stands between characters that are no letters
    or digits. A term meets only texts that hold its first word as a word.
    """
    low = texts.select("id", F.lower("text").alias("low"))
    words = low.select("id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))).alias("word"))
    keyed = terms.withColumn("t", F.lower("term")).withColumn("word", F.regexp_extract("t", WORD, 0)).where("word <> ''")
    met = words.join(keyed, "word").select("id", "term_id", "term", "t").join(low, "id")
    at, n = F.instr(F.col("low"), F.col("t")), F.char_length("t")
    inner = lambda c: c.rlike(r"^[\p{L}\p{N}]$")
    free = (at > 0) & ~inner(F.substring("low", at - 1, F.lit(1))) & ~inner(F.substring("low", at + n, F.lit(1)))
    free = free | ((at == 1) & ~inner(F.substring("low", at + n, F.lit(1))))
    order = Window.partitionBy("id").orderBy("term_id")
    return met.where(free).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("id", "term_id", "term", "place")


def evidence_matches(chunks: DataFrame, locators: DataFrame) -> DataFrame:
    """(locator_id, id): chunks (id, document_id, page_start, page_end, text) that hold a locator's text on its pages.

    Locators are (locator_id, document_id, page_start, page_end, anchors); any anchor will do. Both sides meet on document and
    page, not by a range condition.
    """
    pages = F.explode(F.sequence("page_start", "page_end")).alias("page")
    left = chunks.select("id", "document_id", "text", pages)
    right = locators.select("locator_id", "document_id", "anchors", pages)
    met = left.join(right, ["document_id", "page"])
    return met.where(F.exists("anchors", lambda a: F.col("text").contains(a))).select("locator_id", "id").distinct()


def binding_problems(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem) where the two sides don't bind one to one."""
    a = left.groupBy(key).agg(F.count("*").alias("n"))
    b = right.groupBy(key).agg(F.count("*").alias("m"))
    problem = F.when(F.col("n").isNull(), "no_record").when(F.col("m").isNull(), "no_partner").when((F.col("n") > 1) | (F.col("m") > 1), "not_unique")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def similar_pairs(rows: DataFrame, least: float, tokens: Column, shared: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b, shared, score): pairs of rows (id, document_id, owner) of one owner and different documents whose token sets have a cosine of ``least`` or more.

    Such sets differ in at most na + nb - 2 least sqrt(na nb) tokens, and their sizes by a factor of 1 / least^2 at most. A set's sketch
    holds the parities of its tokens' hashes, two bits a token or more: two sketches never differ in more bits than the sets in tokens. Rows of an owner and a class of
    size are dealt to blocks of about ``block`` rows; a task compares the sketches of two blocks, and only pairs that these leave meet with
    their tokens. All pairs of like sizes are compared, which is quadratic, but no pair is shuffled before that, and a task's memory is bounded.
    """
    floor = least - 5e-7  # scores are rounded to six digits
    step = -math.log(floor)  # two classes, and what rounding adds, are the factor of sizes
    texts = rows.select("id", "document_id", "owner", F.array_distinct(tokens).alias("tokens")).where(F.size("tokens") > 0)
    hashed = texts.select("id", "document_id", "owner", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    sketched = kept(hashed.mapInPandas(_sketches(step), rows.select("id", "document_id", "owner").schema.add("n", "long").add("class", "integer").add("sketch", "binary")))
    sizes = sketched.where("owner is not null").groupBy("owner", "class").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = sketched.join(sizes, ["owner", "class"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
    blocks = sizes.select("owner", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    one, other = (blocks.select("owner", F.col("class").alias(f"{c}_class"), F.col("part").alias(f"{c}_part")) for c in "lr")
    later = (F.col("l_class") < F.col("r_class")) | ((F.col("l_class") == F.col("r_class")) & (F.col("l_part") <= F.col("r_part")))
    both = one.join(other, "owner").where(later & (F.col("r_class") <= F.col("l_class") + 2))
    names = ["owner", "l_class", "l_part", "r_class", "r_part"]
    sent = [dealt.withColumnsRenamed({"class": f"{c}_class", "part": f"{c}_part"}).join(both, ["owner", f"{c}_class", f"{c}_part"]).select(*names, "id", "document_id", "n", "sketch", F.lit(c == "l").alias("left")) for c in "lr"]
    id_type = rows.schema["id"].dataType.simpleString()
    met = kept(sent[0].unionByName(sent[1]).groupBy(*names).applyInPandas(_near_sketches(floor), f"a {id_type}, b {id_type}"))
    asked = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = kept(rows.join(asked, "id", "left_semi").select("id", "document_id", F.array_distinct(tokens).alias("tokens")))
    side = lambda c: sets.select(F.col("id").alias(c), F.col("document_id").alias(f"d{c}"), F.col("tokens").alias(f"t{c}"))
    found = met.join(side("a"), "a").join(side("b"), "b").where("da <> db").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    score = F.round(F.col("shared") / F.sqrt(F.size("ta") * F.size("tb")), 6)
    return found.where(F.col("shared") >= shared).select("a", "b", "shared", score.alias("score")).where(F.col("score") >= least)


def _sketches(step: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n = pdf["h"].map(len).to_numpy()
            sizes = np.floor(np.log(n) / step + 1e-9).astype(int)
            out = []
            for h, c in zip(pdf["h"], sizes):
                bits = 64 << max(0, math.ceil(math.log2(2 * math.exp((c + 1) * step) / 64)))  # the same for a class
                out.append(np.packbits(np.bincount(np.asarray(h, np.int64) & bits - 1, minlength=bits) & 1).tobytes())
            yield pdf.drop(columns="h").assign(n=n, **{"class": sizes}, sketch=out)

    return run


def _near_sketches(floor: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for mine in (pdf[pdf["left"]], pdf[~pdf["left"]]):
            words = np.frombuffer(b"".join(mine["sketch"]), np.uint64).reshape(len(mine), -1) if len(mine) else np.zeros((0, 1), np.uint64)
            sides.append((mine["id"].to_numpy(), mine["document_id"].to_numpy(), mine["n"].to_numpy(float), words))
        (ids, docs, n, x), (ids2, docs2, n2, y) = sides
        while x.shape[1] < y.shape[1]:  # a larger sketch folds to half its bits
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        y, same, found = np.ascontiguousarray(y.T), pdf["l_class"].iloc[0] == pdf["r_class"].iloc[0] and pdf["l_part"].iloc[0] == pdf["r_part"].iloc[0], []
        for i in range(0, len(ids), 128):
            apart = np.zeros((len(ids[i : i + 128]), len(ids2)), np.int32)
            for w in range(len(y)):
                apart += np.bitwise_count(x[i : i + 128, w, None] ^ y[w][None, :])
            most = n[i : i + 128, None] + n2[None, :] - 2 * floor * np.sqrt(n[i : i + 128, None] * n2[None, :]) + 1e-6
            a, b = np.nonzero(apart <= most)
            a += i
            good = (docs[a] != docs2[b]) & ((ids[a] < ids2[b]) if same else True)
            found.append(np.stack([np.minimum(ids[a], ids2[b])[good], np.maximum(ids[a], ids2[b])[good]]))
        pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), int)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return run


def quota_selection(candidates: DataFrame, quotas: dict[str, int], seed: str) -> tuple[list[tuple[str, str, str]], dict[str, int]]:
    """((stratum, id, group) chosen, shortage by stratum) from (id, stratum, group): each quota filled, no group twice.

    Candidates rank by a hash of seed, stratum and id, the best of a group in a stratum counting. Slots are matched
    to groups by augmenting paths, so that a shortage is real. Of a stratum as many groups as there are slots suffice:
    what reaches the driver is bounded by the quotas.
    """
    slots = sum(quotas.values())
    rank = F.sha2(F.concat_ws(":", F.lit(seed), "stratum", "id"), 256)
    rows = candidates.where(F.col("stratum").isin(*quotas)).select("id", "stratum", "group", rank.alias("h"))
    best = rows.groupBy("stratum", "group").agg(F.min(F.struct("h", "id")).alias("b"))
    order = Window.partitionBy("stratum").orderBy(F.col("b")["h"], F.col("b")["id"])
    leading = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= slots).select("stratum", "group", F.col("b")["id"].alias("id"), "r").collect()
    ranked: dict[str, list] = {s: [] for s in quotas}
    for row in sorted(leading, key=lambda r: r["r"]):
        ranked[row["stratum"]].append(row)
    holder: dict[str, tuple[str, int]] = {}
    taken: dict[tuple[str, int], object] = {}

    def place(slot: tuple[str, int]) -> bool:
        """A path of moves that ends at a free group, found breadth first."""
        came: dict[str, tuple] = {}
        todo = [slot]
        for s in todo:
            for row in ranked[s[0]]:
                g = row["group"]
                if g in came:
                    continue
                came[g] = (s, row)
                if g in holder:
                    todo.append(holder[g])
                    continue
                while True:
                    at, row = came[g]
                    old = taken.get(at)
                    holder[g], taken[at] = at, row
                    if at == slot:
                        return True
                    g = old["group"]
        return False

    short: dict[str, int] = {}
    for stratum in sorted(quotas, key=lambda s: (len(ranked[s]) / max(1, quotas[s]), s)):
        for i in range(quotas[stratum]):
            if not place((stratum, i)):
                short[stratum] = short.get(stratum, 0) + 1
    return sorted((s, r["id"], r["group"]) for (s, _), r in taken.items()), short


def greedy_fill(units: Column, scores: Column, must: Column, room: int) -> Column:
    """Places (from 0) of units kept: all of ``must``, then by score, then place, whatever still fits in ``room`` characters with a separator each; score 0 never."""
    size = lambda i: F.char_length(F.element_at(units, i + 1)) + 1
    start = F.struct(must.alias("kept"), F.aggregate(must, F.lit(0), lambda n, i: n + size(i)).alias("used"))
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    rest = F.filter(ranked, lambda r: (r["s"] < 0) & ~F.array_contains(must, r["i"]))

    def step(acc: Column, r: Column) -> Column:
        fits = acc["used"] + size(r["i"]) <= room
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(r["i"]))).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["used"] + size(r["i"])).otherwise(acc["used"]).alias("used"))

    return F.array_sort(F.aggregate(rest, start, step)["kept"])
