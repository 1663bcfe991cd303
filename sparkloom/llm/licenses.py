"""Operator 12, licence scans: Aho-Corasick for phrases and tags, shunting-yard for licence expressions.

A-Z are lower-cased; words are runs of digits, letters and any non-ASCII characters, joined by single spaces. One
Aho-Corasick automaton finds, in one pass over a whole text, every place where the words of a base phrase, a
notice phrase or an identifier tag stand consecutively, overlaps included. Where a tag's words occur, a second one
finds the tags with their punctuation in the lower-cased text, and what follows on the line
is read as an expression: a shunting-yard parser orders its identifiers and operators (``with`` binds closest,
then ``and``, then ``or``), and the postfix form is evaluated to labels and terms: ``or`` leaves the licensee the
easiest side, ``and`` the hardest, and a linking exception weakens the licence that it stands ``with``.

Scale: one pass where the texts are read, nothing is shuffled; automata are built once a Python worker.
Time and memory are linear in a text and its finds.

Defined cases: a null text is empty and has no words; equal rows are scanned alike, each for itself; an
expression ends where the grammar doesn't go on, so that comment marks and prose after it don't count, open parentheses close there and
operators without a right side are dropped; after ``license:`` only expressions of known identifiers count; an unknown identifier
has no label and terms ``unknown``; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "apache org licenses license 2 0": "apache",
    "gnu gpl": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
# Tags, and whether any identifier counts after them.
TAGS = {"spdx-license-identifier:": True, "license-expression:": True, "license:": False, '"license":': False}
TERMS = ("permissive", "weak", "strong", "network", "unknown")
# How identifiers start, their label and terms.
IDENTIFIERS = {
    "mit": ("mit", 0), "apache": ("apache", 0), "bsd": ("bsd", 0), "isc": ("isc", 0), "zlib": ("zlib", 0), "bsl": ("bsl", 0), "python": ("python", 0),
    "unlicense": ("unlicense", 0), "cc0": ("cc0", 0), "cc-by-sa": ("cc-by-sa", 2), "cc-by-nc": ("cc-by-nc", 4), "cc-by": ("cc-by", 0),
    "mpl": ("mpl", 1), "epl": ("epl", 1), "cddl": ("cddl", 1), "lgpl": ("lgpl", 1), "gpl": ("gpl", 2), "agpl": ("agpl", 3),
}
#: Exceptions that let other code link to a work.
LINKING = ("classpath-exception", "gcc-exception", "linking-exception", "llvm-exception", "font-exception", "bootloader-exception")
BINDS = {"with": 3, "and": 2, "or": 1}
#: What a find of a kind says for a licence; finds add up as independent ones.
WEIGHTS = {"base": 0.5, "notice": 0.6, "tag": 0.9}

#: Bytes of words, lower-cased; all other ASCII becomes a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
BLANK = re.compile(r"[ \t\"']*")
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")


@functools.cache
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of phrases and tags between spaces, and of tags as they are written."""
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    found: dict[str, list[tuple[str, str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES)):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((kind, phrase, label))
    for tag in TAGS:
        found.setdefault(normal(tag.encode())[1:-1], []).append(("tag", tag, ""))
        tags.add_word(tag, tag)
    for phrase, told in found.items():
        words.add_word(f" {phrase} ", (len(phrase) + 1, told))
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def normal(data: bytes) -> str:
    """The words of a text between single spaces, a character for each byte."""
    return f" {b' '.join(data.translate(PLAIN).split()).decode('latin-1')} "


def identified(name: str) -> tuple[str | None, int]:
    """Label and terms of an identifier: by the longest start that it has, up to a hyphen or the end."""
    name = name.removesuffix("+")
    while name:
        if name in IDENTIFIERS:
            return IDENTIFIERS[name]
        name = name.rpartition("-")[0]
    return None, TERMS.index("unknown")


def postfix(text: str, at: int = 0) -> tuple[list[str], int]:
    """Shunting-yard: the expression from ``at`` on, operators after their two sides, and where it ends."""
    out: list[str] = []
    stack: list[str] = []
    value_next, opened, end = True, 0, at
    while m := TOKEN.match(text, at):
        token = m[1]
        if value_next and token == "(" and (not stack or stack[-1] != "with"):
            stack.append(token)
            opened += 1
        elif value_next and token not in BINDS and token not in "()":
            out.append(token.rstrip(".:-") or token)
            value_next = False
        elif not value_next and token == ")" and opened:
            while (top := stack.pop()) != "(":
                out.append(top)
            opened -= 1
        elif not value_next and token in BINDS:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            value_next = True
        else:
            break
        at = m.end()
        end = end if value_next else at
    if value_next:  # what stands at the end without a right side
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    out += [x for x in reversed(stack) if x != "("]
    return out, end


def evaluated(tokens: list[str]) -> tuple[list[str], int]:
    """Labels and terms of a postfix expression."""
    stack: list[tuple[set[str], int]] = []
    names: list[str] = []
    for token in tokens:
        if token not in BINDS:
            label, terms = identified(token)
            stack.append(({label} if label else set(), terms))
            names.append(token)
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":  # the right side is the exception last named
            linking = names[-1].startswith(LINKING) or names[-1].rpartition("-")[0] in LINKING
            stack.append((left, TERMS.index("weak") if linking and a == TERMS.index("strong") else a))
        else:
            stack.append((left | right, min(a, b) if token == "or" else max(a, b)))
    labels, terms = stack[-1]
    return sorted(labels), terms


def scan(text: str | None) -> tuple[int, list[dict], list[dict]]:
    """The number of words, the phrases found (kind, phrase, label, word) and the expressions after tags (tag, expression, postfix, labels, terms)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = normal(data)
    phrases, written = automata()
    spans, tagged, at, word = [], False, 0, 0
    for end, (length, told) in phrases.iter(words):
        start = end - length
        # Ends ascend, starts need not: a longer phrase may begin before one that ended earlier.
        word += words.count(" ", at, start) if start >= at else -words.count(" ", start, at)
        at = start
        for kind, phrase, label in told:
            if kind == "tag":
                tagged = True
            else:
                spans.append({"kind": kind, "phrase": phrase, "label": label, "word": word})
    expressions = []
    if tagged:
        low = data.lower().decode("latin-1")
        for end, tag in written.iter(low):
            before = low[end - len(tag) : end - len(tag) + 1] if end >= len(tag) else " "
            if before > "\x7f" or before.isalnum():  # inside a word
                continue
            start = BLANK.match(low, end + 1).end()
            tokens, stop = postfix(low, start)
            names = [t for t in tokens if t not in BINDS]
            if not tokens or not TAGS[tag] and not all(identified(t)[0] or t.startswith(LINKING) for t in names):
                continue
            labels, terms = evaluated(tokens)
            expressions.append({"tag": tag, "expression": low[start:stop], "postfix": tokens, "labels": labels, "terms": TERMS[terms]})
    return words.count(" ") - 1 if len(words) > 2 else 0, spans, expressions


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64())]))
EXPRESSIONS = pa.list_(pa.struct([("tag", pa.string()), ("expression", pa.string()), ("postfix", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("terms", pa.string())]))
SCHEMA = "n_words long, spans array<struct<kind: string, phrase: string, label: string, word: bigint>>, expressions array<struct<tag: string, expression: string, postfix: array<string>, labels: array<string>, terms: string>>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans, expressions of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, expressions = zip(*(scan(t.as_py()) for t in batch.column(1))) if batch.num_rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(expressions, EXPRESSIONS)], names=["doc_id", "n_words", "spans", "expressions"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {SCHEMA}")


def digested(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, terms (of the hardest expression) from ``scanned``."""
    base = F.filter("spans", lambda s: s["kind"] == "base")
    starts = F.transform(base, lambda s: s["word"])

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    own = F.concat(F.transform("spans", lambda s: s["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    weight = F.create_map(*(F.lit(x) for kind in WEIGHTS.items() for x in kind))
    doubt = F.aggregate("spans", F.lit(1.0), lambda p, s: p * (1 - F.element_at(weight, s["kind"])))
    doubt = doubt * F.pow(F.lit(1 - WEIGHTS["tag"]), F.size("expressions"))
    order = F.array(*(F.lit(t) for t in TERMS))
    hardest = F.array_max(F.transform("expressions", lambda e: F.array_position(order, e["terms"]).cast("int")))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda s: s["label"])).alias("base_labels"),
        joined(own).alias("labels"),
        (1 - doubt).alias("score"),
        F.element_at(order, hardest).alias("terms"),
    )


def licensed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of every document's scan."""
    return digested(scanned(docs, id_col, text_col))
