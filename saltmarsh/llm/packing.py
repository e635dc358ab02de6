"""Hierarchical packing of token sequences into windows of several lengths."""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Window lengths, each twice the one before; the last is the longest sequence.
TIERS = (256, 512, 1024, 2048)
#: Words whose ids a Python worker remembers at most; then only those of the texts at hand stay.
REMEMBERED = 500_000
#: New words are encoded so many at a time.
TOGETHER = 500
#: Words of these letters alone are in the tokenizer's own form once they are in lower case, and these are their pieces
#: by its pattern; the two characters that its special tokens begin with are not among them.
PLAIN = re.compile("(?!.*<\\|)[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Ends a piece, as the tokenizer's mark of a word's end; no plain word has it.
MARK = "\0"

_known: dict[str, dict[bytes, bytes]] = {}
_tokenizers: dict = {}


def _plain_encoding(path: str):
    """An encoding of marked pieces with the ids of the file: a byte and the mark is merged first, as the ids are in the order of the merges.

    Also, by id, whether a token ends with the mark.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    suffix, ranks = model["end_of_word_suffix"], {}
    for token, rank in model["vocab"].items():
        bare = token.removesuffix(suffix)
        ranks[bytes(byte_of[c] for c in bare) + (MARK.encode() if bare != token else b"")] = rank
    ends = np.zeros(max(ranks.values()) + 1, bool)
    ends[[rank for token, rank in model["vocab"].items() if token.endswith(suffix)]] = True
    return tiktoken.Encoding("pieces", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={}), ends


class WordTokenizer:
    """Ids of a tokenizer that treats the words between white space apart, as packed 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer.from_file(path), *_plain_encoding(path)
        self.tokenizer, self.plain, self.ends = _tokenizers[path]
        self.known = _known.setdefault(path, {})
        special = [(k, t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        #: A special token parts words that are encoded together.
        self.border_id, self.border = special[0] if special else (None, None)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split() for text in texts]  # at the ASCII white space; other white space is left to the tokenizer
        if len(self.known) > REMEMBERED:
            stay = {w: self.known[w] for w in set().union(*split).intersection(self.known)}
            self.known.clear()
            self.known.update(stay)
        new = sorted(set().union(*split).difference(self.known))
        plain = [w for w in new if PLAIN.fullmatch(w.decode())]
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            self.known.update(zip(some, self._plainly(some), strict=True))
        new = [w for w in new if w not in self.known]
        if self.border is not None:
            mark = self.border.encode()
            alone = [w for w in new if mark in w]
            new = [w for w in new if mark not in w]
            for k in range(0, len(new), TOGETHER):
                some = new[k : k + TOGETHER]
                self.known.update(zip(some, self._together(some), strict=True))
            new = alone
        found = self.tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)
        self.known.update((w, _packed(x.ids)) for w, x in zip(new, found, strict=True))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def _plainly(self, words: list[bytes]) -> list[bytes]:
        """The ids of plain words, from one text of their pieces, each with the mark behind it."""
        pieces = [PIECES.findall(w.decode().lower()) for w in words]
        text = "".join(piece + MARK for word in pieces for piece in word)
        ids = np.array(self.plain.encode_ordinary(text), dtype="<u4")
        ends = np.flatnonzero(self.ends[ids])[np.cumsum([len(p) for p in pieces]) - 1] + 1
        raw, ends = ids.tobytes(), (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, from one text in which the border token stands between the words."""
        text = f" {self.border} ".encode().join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        borders = np.flatnonzero(ids == self.border_id)
        raw, starts, ends = ids.tobytes(), (np.append(0, borders + 1) * 4).tolist(), (np.append(borders, len(ids)) * 4).tolist()
        return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Packer:
    """Collects pieces of documents and hands out full windows.

    A document of the longest window or more fills windows of its own; the rest of it, and each shorter document, is
    routed to the shortest window that holds it. Windows are made from the longest tier down: each takes
    one piece of its tier, and its gap is filled with pieces of shorter tiers, whole ones first, else
    with the head of one, whose tail is routed again. What is left at the end is cut at powers of two.
    """

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers, self.longest = tiers, tiers[-1]
        self.queues: dict[int, deque] = {t: deque() for t in tiers}
        self.waiting = 0

    def _tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def _route(self, document: int, start: int, length: int) -> None:
        self.queues[self._tier(length)].append((document, start, length))

    def add(self, document: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        start = 0
        while length - start >= self.longest:
            yield [(document, start, self.longest)]
            start += self.longest
        if length > start:
            self._route(document, start, length - start)
            self.waiting += length - start

    def _fill(self, window: list, gap: int, below: int) -> int:
        """Fills window from the tiers up to below; the gap that is left."""
        shorter = [t for t in reversed(self.tiers) if t <= below]
        while gap:
            queue = next((self.queues[t] for t in shorter if self.queues[t] and self.queues[t][0][2] <= gap), None)
            if queue is not None:
                piece = queue.popleft()
            elif queue := next((self.queues[t] for t in reversed(shorter) if self.queues[t]), None):
                document, start, length = queue.popleft()
                piece = (document, start, gap)
                self._route(document, start + gap, length - gap)
            else:
                break
            window.append(piece)
            gap -= piece[2]
        return gap

    def flush(self) -> Iterator[list[tuple[int, int, int]]]:
        for tier in reversed(self.tiers):
            while self.queues[tier]:
                piece = self.queues[tier].popleft()
                window = [piece]
                gap = self._fill(window, tier - piece[2], tier // 2)
                gap = gap and self._fill(window, gap, tier)
                yield from _cut(window, tier - gap) if gap else [window]
        self.waiting = 0


def _cut(window: list[tuple[int, int, int]], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """window as windows whose lengths are the powers of two that add up to length."""
    rest = deque(window)
    for power in (1 << k for k in reversed(range(length.bit_length())) if length >> k & 1):
        part, room = [], power
        while room:
            document, start, n = rest.popleft()
            took = min(n, room)
            part.append((document, start, took))
            if n > took:
                rest.appendleft((document, start + took, n - took))
            room -= took
        yield part


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length int, step_group long"


def packed(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 65_536,
    hold_tokens: int = 2_000_000,
) -> DataFrame:
    """A row for each piece of a document: id_col, start, length, ids, doc_tokens, sequence_id, offset, sequence_length, step_group.

    Each document is its ids (by the tokenizer file, without special tokens) and then end_id; ids are packed as 32-bit
    little-endian integers. Sequences have the length of a tier, or another power of two at the end of
    what a task holds, so that none needs padding. Sequences of a tier are dealt evenly to step
    groups of about step_tokens tokens, as many groups as there are full shares.

    Each task packs what it reads, hold_tokens at a time: nothing is shuffled, and a task holds
    those and one document. sequence_id and step_group are unique over all tasks.

    Null or empty text: end_id alone. Null id: packed like any other. Repeated rows: each is packed; their
    pieces share the id, of any type. Empty table: empty result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordTokenizer(tokenizer), _packed([end_id])
        packer, base = Packer(tiers), TaskContext.get().partitionId() << 32
        held: dict[int, tuple[int | None, bytes]] = {}
        windows: list[list[tuple[int, int, int]]] = []
        sequence = group = number = 0
        names = ["id", *[c.split()[0] for c in SCHEMA.split(", ")]]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group, windows
            windows += packer.flush()
            by_length: dict[int, list] = {}
            for window in windows:
                by_length.setdefault(sum(n for _, _, n in window), []).append(window)
            rows: list[list] = [[] for _ in names]
            size = 0
            for length, some in by_length.items():
                groups = max(1, length * len(some) // step_tokens)
                for k, window in enumerate(some):
                    offset = 0
                    for document, start, n in window:
                        doc_id, ids = held[document]
                        row = (doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, base + sequence, offset, length, base + group + k * groups // len(some))
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                        offset, size = offset + n, size + n
                    sequence += 1
                    if size > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
                        rows, size = [[] for _ in names], 0
                group += groups
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
            held.clear()
            windows = []

        waiting = 0
        for batch in batches:
            types = [batch.column(0).type, *types[-8:]]
            for first in range(0, batch.num_rows, 200):
                some = batch.slice(first, 200)
                texts = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(texts), strict=True):
                    held[number] = (doc_id, ids + end)
                    n = len(ids) // 4 + 1
                    windows += packer.add(number, n)
                    number, waiting = number + 1, waiting + n
                    if waiting >= hold_tokens:
                        yield from out()
                        waiting = 0
        if waiting:
            yield from out()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)
