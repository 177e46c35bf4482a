"""Byte-level token ids of texts, chunk by chunk.

A byte-level vocabulary never lets a token cross from a character that is not white space to one that is, and what it does
with a run of white space depends only on the run and on whether a word follows. A text is therefore cut before runs of
white space (those that begin with a blank, as a rule), and the ids of a text are those of its chunks in a row. Chunks repeat, so most
are looked up. Special tokens keep the tokenizer's own treatment: they hold no white space, so they never cross a cut.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_CHUNKS = 400_000     # in each of two generations
CACHED_LENGTH = 40          # longer chunks are not kept
CALL = 1000                 # chunks that one call encodes
# White space by any of the definitions in use: where one of these stands before another, nothing is cut.
BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CUT = "\x00"
WITHIN = re.compile(r"(?<=\S)(?=\s)")


class ByteTokens:
    """Ids by a byte-level tokenizer file. Chunks in use stay for the life of the worker, in two generations."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        special = sorted(i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word))
        self.mark = self.tokenizer.id_to_token(special[0]) if special else None
        self.mark_id = special[0] if special else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; many go through one call, with a special token between them, which is cut out beforehand."""
        if self.mark is None:
            return self._whole(chunks)
        out: list[bytes] = []
        for at in range(0, len(chunks), CALL):
            part = chunks[at:at + CALL]
            text = self.mark.join(part)
            if text.count(self.mark) != len(part) - 1:      # a chunk holds the token itself
                out += self._whole(part)
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            out += [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (none null) in a row, and the offset of each text's first id."""
        # Without white space before a blank, every blank is a cut; other texts are cut by the pattern, and those that hold
        # the sign of a cut are not cut at all.
        rare = pc.match_substring_regex(texts, f"[{BLANK}] |{CUT}").to_numpy(zero_copy_only=False).astype(bool)
        cut = pc.split_pattern(pc.if_else(pa.array(rare), "", texts) if rare.any() else texts, " ")
        first = np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False)))
        coded = cut.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.zeros(len(codes), bool)
        begins[first[:-1]] = True               # a text's first word has no blank before it
        heads, head_codes = np.unique(codes[begins], return_inverse=True)
        codes[begins] = len(words) + head_codes
        held = self._held([f" {w}" for w in words] + [words[i] for i in heads.tolist()])
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = np.frombuffer(b"".join(held), np.uint32)
        n = sizes[codes]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[codes] - before[:-1], n) + np.arange(before[-1])]
        bounds = before[first]
        if not rare.any():
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(rare).tolist():
            text = texts[i].as_py()
            chunks = [text] if CUT in text else WITHIN.split(text)
            parts[i] = np.frombuffer(b"".join(self._held(chunks)), np.uint32)
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def _held(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, looked up or encoded; what the old generation still gives moves to the young one."""
        young, old = self.young, self.old
        held = [young.get(c) for c in chunks]
        fresh = [i for i, h in enumerate(held) if h is None]
        unknown = []
        for i in fresh:
            held[i] = old.get(chunks[i])
            if held[i] is None:
                unknown.append(i)
        for i, h in zip(unknown, self._encode([chunks[i] for i in unknown]), strict=True):
            held[i] = h
        young.update((chunks[i], held[i]) for i in fresh if len(chunks[i]) <= CACHED_LENGTH)
        if len(young) > CACHED_CHUNKS:
            self.young, self.old = {}, young
        return held


_TOKENS: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    """The worker's tokenizer of this file, with its cache."""
    if path not in _TOKENS:
        _TOKENS[path] = ByteTokens(path)
    return _TOKENS[path]
