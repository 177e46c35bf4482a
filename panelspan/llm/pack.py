"""Packing of tokenised documents into fixed windows by best-fit decreasing.

``pack`` reads documents once and shuffles nothing: each task tokenises its rows, cuts overlong documents into full
windows (each is a sequence of its own), and places the rests, longest first, into the open window with the least
room that still suffices. The open windows are found with a segment tree indexed by remaining capacity. A task works
on batches of ``batch_tokens`` tokens, so its memory is bounded whatever the size or skew of the table; a batch of
thousands of windows leaves almost no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_schema, slices, small_batches

WINDOW = 2048
BATCH_TOKENS = 3_000_000
CACHED_WORDS = 250_000      # in each of two generations
MARK = "\x01"               # stands alone between words while many are tokenised in one call
PIECES = "doc_id {0}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class CapacityTree:
    """Segment tree over capacities 0..size; a leaf counts open windows with that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, removed; None if there is none."""
        i = need + self.leaves
        if not self.count[i]:
            while True:             # climb until a right sibling has an open window, then descend to its left end
                if i == 1:
                    return None
                if not i & 1 and self.count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece, and the number of windows. Ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, tree, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), CapacityTree(window), 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = tree.take(n)
        room, at = found if found else (window, used)
        used += not found
        bins[i], offsets[i] = at, window - room
        tree.add(room - n, at)
    return bins, offsets, used


class Words:
    """Token ids of texts, word by word: a text is cut at blanks, which no token of this kind of vocabulary crosses.

    Words in use are kept for the life of the worker: when the young generation is full it becomes the old one, and what
    is not asked for again goes with the next change.
    """

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def _encode(self, words: list[str]) -> list[bytes]:
        if len(self.mark) != 1 or any(MARK in w for w in words):
            return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            text = f" {MARK} ".join(words[i:i + 1000])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark[0])).tolist()
            out += [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the offset of each text's first id.

        A text that may hold a special token, which the tokenizer finds before anything else, is encoded as a whole.
        """
        low = pc.ascii_lower(texts)
        whole = np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.match_substring(low, token).to_numpy(zero_copy_only=False)
        if whole.any():
            ids, bounds = self._by_words(pc.if_else(pa.array(whole), "", low))
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i in np.flatnonzero(whole).tolist():
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return self._by_words(low)

    def _by_words(self, low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        for blank in "\n\t\r":
            low = pc.replace_substring(low, blank, " ")
        lists = pc.split_pattern(low, " ")
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        young, old = self.young, self.old
        held = [young.get(w) or old.get(w) for w in words]
        fresh = [w for w, h in zip(words, held, strict=True) if h is None]
        got = iter(self._encode(fresh))
        held = [next(got) if h is None else h for h in held]
        young.update(zip(words, held, strict=True))
        if len(young) > CACHED_WORDS:
            self.young, self.old = {}, young
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = np.frombuffer(b"".join(held), np.uint32)
        n = sizes[codes]
        before = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(starts[codes] - before[:-1], n) + np.arange(before[-1])
        bounds = before[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
        return flat[take], bounds


_WORDS: dict[str, Words] = {}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, batch_tokens: int = BATCH_TOKENS,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    One row per piece: doc_id, start (ids of its document before it), length, doc_tokens (with the end id), sequence_id,
    offset (place in the sequence; the pieces of a sequence leave no gap from 0) and ids (little-endian unsigned 32-bit).
    A null or empty text has only the end id. Rows with the same or a null id are separate documents. Ties of length
    keep the order of the rows. Other columns are not read. An empty table gives no rows.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]
    ddl = PIECES.format(kind)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _WORDS:
            _WORDS[tokenizer] = Words(tokenizer)
        words, first = _WORDS[tokenizer], TaskContext.get().partitionId() << 40
        tokens, held, size = [], [], 0
        for batch in batches:
            for part in slices(batch, 1, 4_000_000):
                flat, bounds = words.ids(pc.fill_null(part.column(1), ""))
                key = part.column(0)
                for i in range(part.num_rows):
                    tokens.append(np.append(flat[bounds[i]:bounds[i + 1]], np.uint32(end_id)))
                held.append(key)
                size += int(bounds[-1]) + part.num_rows
                if size >= batch_tokens:
                    out, first = _windows(pa.concat_arrays(held), tokens, window, first, schema)
                    yield out
                    tokens, held, size = [], [], 0
        if tokens:
            yield _windows(pa.concat_arrays(held), tokens, window, first, schema)[0]

    return docs.select(id_column, text_column).mapInArrow(run, ddl)


def _windows(keys: pa.Array, tokens: list[np.ndarray], window: int, first: int, schema: pa.Schema) -> tuple[pa.RecordBatch, int]:
    """Cut, place and return the pieces of one batch, and the next free sequence number."""
    n = np.fromiter((len(t) for t in tokens), np.int64, len(tokens))
    full, rest = n // window, n % window
    owner = np.concatenate([np.repeat(np.arange(len(n)), full), np.flatnonzero(rest)])
    nth = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    start = np.concatenate([nth * window, (full * window)[rest > 0]])
    length = np.concatenate([np.full(full.sum(), window), rest[rest > 0]])
    bins, offsets, used = best_fit_decreasing(rest[rest > 0], window)
    sequence = np.concatenate([np.arange(full.sum()), full.sum() + bins]) + first
    offset = np.concatenate([np.zeros(full.sum(), np.int64), offsets])
    data = [tokens[d][s:s + k].tobytes() for d, s, k in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True)]
    columns = [keys.take(pa.array(owner)), *[pa.array(c.astype(np.int64)) for c in (start, length, n[owner], sequence, offset)],
               pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=schema), first + int(full.sum()) + used
