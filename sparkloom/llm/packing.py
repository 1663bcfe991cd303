"""Operator 1, packing: token windows balanced by Karmarkar-Karp multiway differencing.

Every document becomes token ids plus an end id. Runs of ``capacity`` ids fill whole
sequences; what is left over of each document (its tail) is collected, a bounded number at
a time, and dealt to windows by differencing: partial partitions are held as sorted tuples
of window sums, and the two with the largest imbalance are merged so that the heaviest
window of one meets the lightest of the other. Starting from ceil(total / capacity)
windows, the count rises by one while the heaviest window exceeds the capacity.

Scale: each task packs what it reads, so there is no shuffle, and a task holds one batch
of tails, whatever the size of the input. Sequence ids carry the task's partition number.
Defined cases: ids are the tokenizer's as loaded, without added special tokens (the text of a
special token is that token); null text is empty (one end id); a null id is kept as null; repeated rows
are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
#: Tails that are balanced together, and the longest run of a tail that stays in one piece.
TAILS, LONGEST_PIECE = 1024, 512
#: Distinct words whose ids a worker keeps; beyond that the table starts anew.
CACHED_WORDS = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies spell each byte with: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    White space never takes part in a token of this vocabulary, so a text's ids are those
    of its runs of other characters, one after another; runs seen before come from a table.
    Runs of Latin letters and signs are normalised and cut here by the tokenizer's own rule,
    and only their new parts go to its BPE model; all other runs go through it whole.
    """

    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    LATIN = re.compile(r"[\t-\r \x21-\x7e\xa1-\u024f]+")
    CONTROLS = bytes([*range(9), *range(14, 32), 127])
    BYTES = byte_letters()

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        # Runs that hold a special token's text (or look like it) are left to the tokenizer as they are.
        self.specials = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.parts_model = Tokenizer(self.model.model)
        self.parts_model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, bytes] = {}
        mark = next(c for c in "\u2764\u2728\u2022\u20ac" if len(self.encode(c)) == 1)  # outside LATIN, so in no part
        self.mark, self.mark_id = "".join(self.BYTES[b] for b in mark.encode()), self.encode(mark)[0]

    def encode(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def special(self, text: str) -> bool:
        low = text.lower()
        return any(s in low for s in self.specials)

    def latin(self, text: str) -> bool:
        if text.isascii():  # the same test, by a faster way
            raw = text.encode()
            return len(raw.translate(None, self.CONTROLS)) == len(raw)
        return self.LATIN.fullmatch(text) is not None

    def normal(self, text: str) -> str:
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()

    def split(self, text: str) -> list[str]:
        """The runs of a text, Latin ones in their normal form, all others as they are."""
        held = self.special(text)
        if not held and self.latin(text):
            return self.normal(text).split()
        runs = [w.decode() for w in text.encode("utf-8", "replace").split()]
        return [self.normal(w) if self.latin(w) and not (held and self.special(w)) else w for w in runs]

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = words
        known = self.known
        cut: dict[str, list[str]] = {}
        fresh: list[str] = []  # parts are runs too: one table serves both
        for w in new:
            if w.isalpha() and (w.isascii() or self.LATIN.fullmatch(w)):
                fresh.append(w)
            elif self.latin(w) and not self.special(w):
                cut[w] = self.PARTS.findall(w)
            else:
                known[w] = np.array(self.encode(w), "<u4").tobytes()
        fresh += {p for ps in cut.values() for p in ps}.difference(known, new)
        fresh += {w for w, ps in cut.items() if ps == [w]}
        for i in range(0, len(fresh), 500):
            some = fresh[i : i + 500]
            spelled = [p if p.isascii() else "".join([self.BYTES[b] for b in p.encode()]) for p in some]
            ids = np.array(self.parts_model.encode_batch_fast([f" {self.mark} ".join(spelled)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            raw, start = ids.tobytes(), 0
            for p, e in zip(some, ends, strict=True):
                known[p] = raw[4 * start : 4 * e]
                start = e + 1
        for w, ps in cut.items():
            known[w] = b"".join([known[p] for p in ps])

    def texts(self, texts: list[str | None], at_once: int = 64) -> Iterator[bytes]:
        for i in range(0, len(texts), at_once):
            split = [self.split(t or "") for t in texts[i : i + at_once]]
            self.learn(set().union(*split))
            get = self.known.__getitem__
            for words in split:
                yield b"".join(map(get, words))


def differencing(sizes: list[int], windows: int) -> list[int]:
    """The window of each item, by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    if windows <= 1:
        return [0] * n
    left, right = [], []  # children of inner nodes; node i < n is item i

    def single(i: int) -> tuple[np.ndarray, np.ndarray]:
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = sizes[i], i
        return sums, nodes

    heap = [(-s, i, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        (sa, na), (sb, nb) = a or single(i), b or single(j)
        sums, nb = sa + sb[::-1], nb[::-1]
        nodes = np.maximum(na, nb)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        if len(both):
            nodes[both] = n + len(left) + np.arange(len(both))
            left.extend(na[both].tolist())
            right.extend(nb[both].tolist())
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), count, (sums, nodes)))
        count += 1
    nodes = (heap[0][2] or single(heap[0][1]))[1]
    out = [0] * n
    for w, node in enumerate(nodes.tolist()):
        todo = [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                out[x] = w
            else:
                todo += (left[x - n], right[x - n])
    return out


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Windows that hold at most ``capacity``; their count rises until that is so."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, windows)
        if not sizes or np.bincount(dealt, weights=sizes).max() <= capacity:
            return dealt
        windows += 1


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of token sequences (see the module); ``with_ids`` adds each piece's ids."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000)  # millions of small objects live here, none in cycles
        tokenizer = WordTokenizer(tokenizer_path)
        base, used = TaskContext.get().partitionId() << 33, 0
        tails: list[tuple] = []
        held = 0
        rows: list[tuple] = []

        def piece(doc, ids: bytes, start: int, length: int, total: int) -> tuple:
            part = ids[4 * start : 4 * (start + length)]
            return (doc, start, length, zlib.crc32(part), total), (np.frombuffer(part, "<u4").tolist() if with_ids else None)

        def flush() -> None:
            nonlocal used
            dealt = windows_of([p[0][2] for p in tails], capacity)
            offsets: dict[int, int] = {}
            for (p, ids), w in zip(tails, dealt):
                at = offsets.get(w, 0)
                rows.append((*p, base + used + w, at, ids))
                offsets[w] = at + p[2]
            used += max(dealt, default=-1) + 1
            tails.clear()

        def out() -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(zip(*rows), types, names)], names=names)
            rows.clear()
            return done

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(ids_of, tokenizer.texts(texts)):
                ids += end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    p, tokens = piece(doc, ids, start, capacity, total)
                    rows.append((*p, base + used, 0, tokens))
                    used += 1
                rest = total - whole
                cuts = max(1, -(-rest // LONGEST_PIECE)) if rest else 0
                for c in range(cuts):
                    start = whole + rest * c // cuts
                    tails.append(piece(doc, ids, start, whole + rest * (c + 1) // cuts - start, total))
                held += 1
                if held >= TAILS:
                    flush()
                    held = 0
                if len(rows) >= 10_000:
                    yield out()
        if tails:
            flush()
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
