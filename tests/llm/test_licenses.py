"""Licence scans: against plain searches and a recursive-descent reader, and defined cases."""

from __future__ import annotations

import random
import re

import pytest

from sparkloom.llm import licenses, queries


def words_of(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(text):
    """Every place of every phrase, word by word."""
    words = words_of(text)
    out = []
    for kind, phrases in (("base", licenses.BASE), ("notice", licenses.NOTICES)):
        for phrase, label in phrases.items():
            want = phrase.split()
            out += [(kind, phrase, label, i) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), sorted(out)


def descent(tokens):
    """(labels, terms) by recursive descent over whole, valid expressions."""

    def atom():
        if tokens[0] == "(":
            tokens.pop(0)
            value = either()
            assert tokens.pop(0) == ")"
        else:
            label, terms = licenses.identified(tokens.pop(0))
            value = ({label} if label else set(), terms)
        while tokens[:1] == ["with"]:
            exception = tokens[1]
            del tokens[:2]
            value = (value[0], 1 if value[1] == 2 and exception.startswith(licenses.LINKING) else value[1])
        return value

    def both():
        value = atom()
        while tokens[:1] == ["and"]:
            tokens.pop(0)
            right = atom()
            value = (value[0] | right[0], max(value[1], right[1]))
        return value

    def either():
        value = both()
        while tokens[:1] == ["or"]:
            tokens.pop(0)
            right = both()
            value = (value[0] | right[0], min(value[1], right[1]))
        return value

    labels, terms = either()
    return sorted(labels), terms


def expression(rng, deep):
    name = rng.choice(["mit", "apache-2.0", "gpl-2.0-only", "gpl-3.0+", "lgpl-2.1-or-later", "agpl-3.0", "licenseref-own", "mpl-2.0", "0bsd"])
    if deep == 0 or rng.random() < 0.2:
        return name if rng.random() < 0.6 else f"{name} with {rng.choice(['classpath-exception-2.0', 'gcc-exception-3.1', 'autoconf-exception-3.0'])}"
    a, op, b = expression(rng, deep - 1), rng.choice(["and", "or"]), expression(rng, deep - 1)
    return rng.choice(["{} {} {}", "({} {} {})", "{} {} ({})", "({}) {} {}"]).format(a, op, b)


def test_shunting_yard_equals_recursive_descent():
    rng = random.Random(2)
    for _ in range(500):
        text = expression(rng, 3)
        tokens, end = licenses.postfix(text)
        assert end == len(text)
        assert licenses.evaluated(tokens) == descent(re.findall(r"[()]|[^\s()]+", text))


@pytest.mark.parametrize(
    "text, tokens, labels, terms",
    [
        ("SPDX-License-Identifier: MIT */", ["mit"], ["mit"], "permissive"),
        ("// spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT\nand apache", ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or"], ["gpl", "mit"], "permissive"),
        ("SPDX-License-Identifier: (GPL-2.0 AND (MIT OR", ["gpl-2.0", "mit", "and"], ["gpl", "mit"], "strong"),
        ("SPDX-License-Identifier: MIT this is prose", ["mit"], ["mit"], "permissive"),
        ("SPDX-License-Identifier: GPL-3.0 with (MIT)", ["gpl-3.0"], ["gpl"], "strong"),
        ("SPDX-License-Identifier: LicenseRef-x", ["licenseref-x"], [], "unknown"),
        ('{"license": "Apache-2.0"}', ["apache-2.0"], ["apache"], "permissive"),
        ("License: BSD-3-Clause AND LGPL-2.1+", ["bsd-3-clause", "lgpl-2.1+", "and"], ["bsd", "lgpl"], "weak"),
    ],
)
def test_tags(text, tokens, labels, terms):
    ((found),) = licenses.scan(text)[2]
    assert (found["postfix"], found["labels"], found["terms"]) == (tokens, labels, terms)


@pytest.mark.parametrize("text", ["SPDX-License-Identifier:", "SPDX-License-Identifier:\nMIT", "SPDX-License-Identifier: AND MIT", "SPDX-License-Identifier: ((", "license: unknown to all", "xlicense: mit", "Élicense: mit", "spdx license identifier mit"])
def test_no_tags(text):
    assert licenses.scan(text)[2] == []


def test_phrases_equal_a_plain_search():
    rng = random.Random(1)
    pieces = [*licenses.BASE, *licenses.NOTICES, "mit", "license", "MIT-LICENSE", "the", "general", "Öffentlich", "apache.license", "mit license" * 2, " ", "\x85", "gnu"]
    for _ in range(300):
        text = rng.choice([" ", ", ", "\n", ""]).join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        count, spans, _ = licenses.scan(text)
        assert (count, sorted((s["kind"], s["phrase"], s["label"], s["word"]) for s in spans)) == plain(text)


def test_defined_cases(documents):
    long = "mit license " * 20_000
    rows = [(1, None), (2, ""), (3, "The MIT License, general public license"), (3, "The MIT License, general public license"), (4, long), (None, "SPDX-License-Identifier: ISC"), (5, "...")]
    got = {(r.doc_id, r.n_words): r for r in licenses.licensed(documents(rows)).collect()}
    assert got[1, 0].labels == "" == got[2, 0].base_labels and got[1, 0].score == 0 and got[1, 0].first_word is None and got[5, 0].n_base == 0
    assert (got[3, 6].n_base, got[3, 6].first_word, got[3, 6].last_word, got[3, 6].base_labels) == (2, 1, 3, "gpl,mit")
    assert (got[4, 40_000].n_base, got[4, 40_000].last_word) == (20_000, 39_998) and got[4, 40_000].score == 1
    assert got[None, 4].labels == "isc" and got[None, 4].base_labels == "" and got[None, 4].terms == "permissive"
    assert licenses.licensed(documents(rows)).count() == len(rows) and licenses.licensed(documents([])).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op12_licenses(spark, sf).collect()
    assert len(got) == len(texts) and any(r.n_base for r in got)
    for r in got:
        count, spans = plain(texts[r.doc_id])
        base = [s for s in spans if s[0] == "base"]
        assert (r.n_words, r.n_base, r.base_labels) == (count, len(base), ",".join(sorted({s[2] for s in base})))
        assert (r.first_word, r.last_word) == (min((s[3] for s in base), default=None), max((s[3] for s in base), default=None))
        assert {s[2] for s in spans} <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
