from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import packing
from sparkloom.llm.queries import op1_packing, table, tokenizer

PATH = tokenizer("word_bpe_49k.json")


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def checked(pieces, texts):
    """Pieces cover every id once and sequences are gapless and within the capacity; padding as a share."""
    ids = {i: x for i, x in zip(texts, reference_ids(texts.values()))}
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, parts in covered.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[i])
    assert set(covered) == set(ids)
    used = 0
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= packing.CAPACITY
        used += at
    return 1 - used / (packing.CAPACITY * len(sequences))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert checked(op1_packing(spark, sf).collect(), texts) < 0.01


def test_edges(documents):
    odd = ["", None, "É́té naïve ΣΑΣ  x y", "<|endoftext|> it's 12 ❤ 日本 ퟿", "a" * 9000, "word " * 9000, "\x00\x1c'S don'T ſ İ K", "é" * 50, "é ñ"]
    texts = dict(enumerate(odd))
    checked(packing.pack(documents(texts.items()), PATH).collect(), texts)


def test_repeats_nulls_and_empty_table(documents):
    rows = packing.pack(documents([(1, "the same"), (1, "the same"), (None, "no id")]), PATH, with_ids=True).collect()
    assert len(rows) == 3 and sum(r.doc_id is None for r in rows) == 1 and all(r.ids[-1] == 2 for r in rows)
    assert packing.pack(documents([]), PATH).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=60))
def test_windows_hold(sizes):
    dealt = packing.windows_of(sizes)
    assert len(dealt) == len(sizes)
    if sizes:
        sums = np.bincount(dealt, weights=sizes)
        assert sums.max() <= packing.CAPACITY and len(sums) <= -(-sum(sizes) // packing.CAPACITY) + 1


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40))
def test_any_text_has_the_tokenizer_s_ids(text):
    t = packing.WordTokenizer(PATH)
    got = np.frombuffer(next(t.texts([text])), "<u4").tolist()
    assert got == reference_ids([text.encode("utf-8", "replace").decode()])[0][:-1]


def test_texts_of_special_tokens():
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "caf\u00e9<|endoftext|>\u0416 it's", "<|endoftext|><|endoftext|>", "\u4e2d<|startoftext|>\u6587 <|EndOfText|>x"]
    got = [[*np.frombuffer(b, "<u4").tolist(), 2] for b in packing.WordTokenizer(PATH).texts(texts)]
    assert got == reference_ids(texts)
