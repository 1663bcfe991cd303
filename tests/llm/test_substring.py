from __future__ import annotations

import random

import numpy as np

from sparkloom.llm import substring
from sparkloom.llm.common import ascii_words
from sparkloom.llm.queries import op8_substring, table


def covered(texts):
    """Words inside a run of 50 words that an earlier document holds, by brute force."""
    words = {i: ascii_words(t) for i, t in texts.items()}
    first, out = {}, {}
    for i in sorted(words):
        w, mark = words[i], np.zeros(len(words[i]), bool)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                mark[k : k + 50] = True
        out[i] = mark
    return out


def marked(row, n):
    mark = np.zeros(n, bool)
    for s in row.spans:
        a, b = map(int, s.split("-"))
        mark[a:b] = True
    return mark


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    want = covered(texts)
    rows = op8_substring(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    missed = total = 0
    for r in rows:
        mark = marked(r, len(want[r.doc_id]))
        assert r.n_words == len(mark) and r.n_dup_words == mark.sum() and r.n_spans == len(r.spans) and r.doc_id not in r.of_docs
        missed, total = missed + (want[r.doc_id] & ~mark).sum(), total + want[r.doc_id].sum()
    assert missed <= 0.002 * total


def text_of(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_planted_passages(documents):
    rng = random.Random(8)
    passage = text_of(rng, 60)
    edited = passage[:30] + ["edit"] + passage[31:]
    docs = {
        3: text_of(rng, 80) + passage + text_of(rng, 30), 7: passage + text_of(rng, 200), 9: text_of(rng, 100) + edited, 11: text_of(rng, 300), 12: text_of(rng, 20) + passage[:30] + text_of(rng, 20),
        13: text_of(rng, 40) + passage + text_of(rng, 5) + passage,
    }
    df = documents([(i, " ".join(w)) for i, w in docs.items()])
    got = {r.doc_id: r for r in substring.duplicated_words(df).collect()}
    assert got[3].spans == [] and got[11].spans == [] and got[12].spans == []  # the first keeps it; 30 words are too few
    assert got[7].spans == ["0-60"] and got[7].of_docs == [3] and got[9].spans == ["100-160"]
    assert got[13].spans == ["40-100", "105-165"]
    kept = substring.without_repeats(df)
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert kept.columns == df.columns and texts[7][0].split() == docs[7][60:] and texts[9][0].split() == docs[9][:100]
    assert all(n == len(t) for t, n in texts.values()) and texts[11][0].split() == docs[11]


def test_a_passage_in_many_documents_stays_linear(documents):
    rng = random.Random(2)
    passage = text_of(rng, 70)
    rows = [(i, " ".join(text_of(rng, 5) + passage + text_of(rng, 5))) for i in range(200)]
    got = {r.doc_id: r for r in substring.duplicated_words(documents(rows)).collect()}
    assert got[0].n_dup_words == 0 and all(got[i].spans == ["5-75"] and got[i].of_docs == [0] for i in range(1, 200))


def test_edges(documents):
    rng = random.Random(5)
    same, other = " ".join(text_of(rng, 90)), " ".join(text_of(rng, 90))
    rows = [(1, None), (2, ""), (3, "und " * 30_000), (4, "und " * 30_000), (5, same), (5, same), (6, same), (7, other), (7, same), (None, same)]
    df = documents(rows)
    got = [(r.doc_id, r.n_dup_words) for r in substring.duplicated_words(df).collect()]
    assert len(got) == len(rows) and dict(got)[6] == 90
    assert all(n == 0 for i, n in got if i in (1, 2, 5, 7, None))  # 7 repeats an id with different texts
    assert substring.without_repeats(df).count() == len(rows)
    assert substring.duplicated_words(documents([])).collect() == [] and substring.without_repeats(documents([])).collect() == []


def test_chains_are_optimal():
    """Fenwick chaining against all chains of a few runs."""
    rng = random.Random(4)
    for _ in range(60):
        y = np.array(sorted(rng.sample(range(400), 12)))
        x = np.array([max(0, v + rng.choice([0, 0, 0, 3, -5, 40])) for v in y])
        runs = substring.diagonal_runs(y, x)
        chains = substring.best_chains(runs)
        assert sorted(r for c in chains for r in c) == runs
        assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for c in chains for a, b in zip(c, c[1:]))

        def score(c):
            gaps = sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(c, c[1:]))
            return sum(r[2] for r in c) - substring.GAP_COST * gaps

        best = {}
        for r in runs:
            before = [best[q] + [r] for q in best if q[0] + q[2] <= r[0] and q[1] + q[2] <= r[1]]
            best[r] = max([[r], *before], key=score)
        assert abs(score(chains[0]) - max(map(score, best.values()))) < 1e-9


def test_passages_near_one_another_are_judged_apart(documents):
    """Exact passages with 25 to 60 other words between them are found whole, the words between never."""
    rng = random.Random(21)
    docs, want = {}, {}
    cases = [(n, gap, m) for n, m in ((55, 55), (60, 10), (200, 200), (50, 90)) for gap in (25, 40, 50, 60)]
    for i, (n, gap, m) in enumerate(cases):
        first, second = text_of(rng, n), text_of(rng, m)
        docs[i] = text_of(rng, 30) + first + text_of(rng, gap) + second + text_of(rng, 30)
        docs[1000 + i] = text_of(rng, 20) + first + text_of(rng, gap) + second + text_of(rng, 20)
        want[1000 + i] = [f"20-{20 + n}", f"{20 + n + gap}-{20 + n + gap + m}"][: 1 if m < 50 else 2]
    got = {r.doc_id: r.spans for r in substring.duplicated_words(documents([(i, " ".join(w)) for i, w in docs.items()])).collect()}
    assert {i: s for i, s in got.items() if s} == want


def test_a_replaced_phrase_stays_within_its_passage():
    rng = random.Random(22)
    passage = text_of(rng, 100)
    for edit, parts in ((3, 1), (5, 1), (6, 2), (30, 2)):
        a = passage[:50] + text_of(rng, edit) + passage[50 + edit :] if edit < 10 else passage[:50] + text_of(rng, edit) + passage[50:]
        found = substring.aligned(a, passage, [(0, 0, 10), (len(a) - 10, 90, 10)])
        assert len(found) == parts and found[0][0] == 0 and found[-1][1] == len(a)


def seed_places(words):
    return [int(v) for v in substring.seeds_of(" ".join(words))[1]]


def test_a_passage_with_one_seed_left_is_found(documents):
    """Edits at every fifth word but in the middle leave a single seed: extension runs over them, on either side of it."""
    rng = random.Random(31)
    docs, want, at = {}, {}, 0
    while len(want) < 12:
        passage = text_of(rng, 59)
        edited = ["edit" if i % 5 == 4 and not 25 <= i < 28 + substring.K else w for i, w in enumerate(passage)]
        earlier, later = text_of(rng, 25) + passage + text_of(rng, 25), text_of(rng, 25) + edited + text_of(rng, 25)
        shared = {tuple(earlier[v : v + substring.K]) for v in seed_places(earlier)} & {tuple(later[v : v + substring.K]) for v in seed_places(later)}
        if len(shared) == 1:
            docs[at], docs[1000 + at], want[1000 + at] = earlier, later, ["25-84"]
            at += 1
    got = {r.doc_id: r.spans for r in substring.duplicated_words(documents([(i, " ".join(w)) for i, w in docs.items()])).collect()}
    assert {i: s for i, s in got.items() if s} == want


def test_seeds_that_stand_earlier_in_the_same_document(documents):
    """An exact passage of 50 words, all but one of whose seeds the earlier document holds on lines before it."""
    rng = random.Random(32)
    docs, want = {}, {}
    for at in range(12):
        passage = text_of(rng, 50)
        later = text_of(rng, 40) + passage + text_of(rng, 40)
        inside = [v - 40 for v in seed_places(later) if 40 <= v <= 90 - substring.K]
        lines = [passage[v : v + substring.K] + text_of(rng, 90) for k, v in enumerate(inside) if k != at % len(inside)]
        docs[at] = sum(lines, text_of(rng, 30)) + passage + text_of(rng, 40)
        docs[1000 + at], want[1000 + at] = later, ["40-90"]
    got = {r.doc_id: r.spans for r in substring.duplicated_words(documents([(i, " ".join(w)) for i, w in docs.items()])).collect()}
    assert {i: s for i, s in got.items() if s} == want


def test_copies_with_an_edit_at_every_tenth_word(documents):
    """Nine equal words in a row are sure of a seed: substituted, dropped and added words, whatever the length."""
    rng = random.Random(33)
    docs, want = {}, {}
    for at in range(24):
        n = (60, 100, 300)[at % 3]
        passage = text_of(rng, n - 1)
        kinds = [["edit"], [], None][at // 3 % 3]
        edited = [v for i, w in enumerate(passage) for v in ([w] if i % 10 != 9 else [w, "edit"] if kinds is None else kinds)]
        docs[at], docs[1000 + at] = text_of(rng, 25) + passage + text_of(rng, 25), text_of(rng, 25) + edited + text_of(rng, 25)
        want[1000 + at] = [f"25-{25 + len(edited)}"]
    got = {r.doc_id: r.spans for r in substring.duplicated_words(documents([(i, " ".join(w)) for i, w in docs.items()])).collect()}
    assert {i: s for i, s in got.items() if s} == want


def test_recall_of_edited_passages(documents):
    """One edit every 8 to 30 words: at least 0.95 of a passage's words; random edits: as README says."""
    rng = random.Random(34)
    cells = [(gap, 0.0, n) for gap in (8, 12, 14, 16, 20, 30) for n in (60, 80, 150, 300)] + [(0, 0.05, 60), (0, 0.05, 120), (0, 0.1, 120)]
    rows, planted = [], {}
    for cell in cells:
        gap, rate, n = cell
        for _ in range(20):
            passage, before = text_of(rng, n), text_of(rng, rng.randint(20, 80))
            edited = []
            for j, w in enumerate(passage):
                if gap and j % gap == gap - 1 or rng.random() < rate:
                    edited += rng.choice([["edit"], [], [w, "edit"]])
                else:
                    edited.append(w)
            at = len(rows)
            rows += [(at, " ".join(text_of(rng, 40) + passage + text_of(rng, 40))), (at + 1, " ".join(before + edited + text_of(rng, 40)))]
            planted[at + 1] = cell, len(before), len(edited)
    got = {r.doc_id: r for r in substring.duplicated_words(documents(rows)).collect()}
    shares = {cell: [] for cell in cells}
    for i, (cell, start, n) in planted.items():
        mark = marked(got[i], got[i].n_words)
        shares[cell].append(mark[start : start + n].mean())
        assert mark[:start].sum() + mark[start + n :].sum() <= 6 and got[i - 1].spans == []
    assert all(np.mean(v) >= (0.95 if cell[0] else 0.9) for cell, v in shares.items()), {c: round(float(np.mean(v)), 3) for c, v in shares.items()}


def test_words_that_repeat_without_a_break(documents):
    """A word repeated 40 to 500 times: where the earlier document repeats it 50 times or more, all of it is a repeat."""
    rng = random.Random(35)
    docs = [(0, " ".join(text_of(rng, 30) + ["the"] * 60 + text_of(rng, 30)))]
    docs += [(n, " ".join(text_of(rng, 20) + ["the"] * n + text_of(rng, 20))) for n in (50, 61, 130, 500)]
    docs += [(1000, " ".join(text_of(rng, 20) + ["a", "b", "c"] * 60)), (1001, " ".join(text_of(rng, 20) + ["a", "b", "c"] * 150))]
    got = {r.doc_id: r.spans for r in substring.duplicated_words(documents(docs)).collect()}
    assert got == {0: [], 50: ["20-70"], 61: ["20-81"], 130: ["20-150"], 500: ["20-520"], 1000: [], 1001: ["20-470"]}
