"""Removal of byte strings that an earlier document holds, through maximal repeats of enhanced suffix arrays.

A string of ``LEAST`` bytes is found by its anchor, the rightmost least hash of the ``GRAM``-byte grams inside it: equal
strings have equal anchors, wherever they are. The strings of one anchor lie side by side, so an anchor stands for all of
them with one stretch of text. Three passes over blocks of texts (``blocks``):

1. which anchors occur in more than one document (four bytes for each anchor of a block);
2. the stretches of those anchors, each once per block with its least document id, meet by anchor. Their suffixes are
   sorted, common prefixes of neighbours are measured, and a stack scan of the common-prefix interval tree gives the groups
   of suffixes that share ``LEAST`` bytes or more. A group whose occurrences are preceded by different bytes (or begin
   a stretch) is a maximal repeat; every shared string lies in one with the same occurrences. Each string of a stretch gets the
   least document id of the repeats that cover it;
3. each text drops the bytes of strings whose least id is smaller than its own.

A string that a third of all documents hold is one entry per block, and no group holds its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import arrow_schema

LEAST, GRAM = 50, 24
BLOCK_BYTES = 4_000_000
PLACE_BITS = 18             # texts are scanned in parts of less than 2 ** 18 bytes, which the caches hold
NEVER = np.iinfo(np.int64).max
SUFFIXES = 150_000          # suffixes sorted at once
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 24 bytes from each place."""
    power, h, sizes = MULTIPLY, data.astype(np.uint64) + np.uint64(1), {}
    for n in (1, 2, 4, 8):
        h = h[:-n] * power + h[n:]
        with np.errstate(over="ignore"):
            power = power * power
        sizes[2 * n] = h
    eight, sixteen = sizes[8], sizes[16]
    with np.errstate(over="ignore"):
        h = sixteen[:len(eight) - 16] * (MULTIPLY ** np.uint64(8)) + eight[16:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def least_of(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n, m = 1, v
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return m if n == width else np.minimum(m[:len(m) - (width - n)], m[width - n:])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last string start, and text of each anchor; texts lie one after the other in ``data``."""
    found = []
    for low, high in _parts(ends):
        part = data[low:high]
        if len(part) < LEAST:
            continue
        h = gram_hashes(part)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        v = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
        place = (mask - (least_of(v, LEAST - GRAM + 1) & mask)).astype(np.int32)        # of the anchor of the string at each start
        # No string starts in the last bytes of a text; so the strings of two texts never touch.
        inside = np.zeros(len(place) + 2, bool)
        inside[1:-1] = True
        for end in ends[np.searchsorted(ends, low, "right"):np.searchsorted(ends, high, "right")] - low:
            inside[max(end - LEAST + 2, 1):end + 1] = False
        differ = place[1:] != place[:-1]
        here = inside[1:-1]
        first = np.flatnonzero(here & (~inside[:-2] | np.concatenate([[True], differ])))
        last = np.flatnonzero(here & (~inside[2:] | np.concatenate([differ, [True]])))
        if len(first):
            found.append((h[place[first]], first + low, last + low, np.searchsorted(ends, first + low, "right")))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _parts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Whole texts together up to a size; a longer text in overlapping parts, so that each of its strings is in one."""
    most, begin, at = (1 << PLACE_BITS) - 1, 0, 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, begin + (most >> 1), "right"))
        if upto > at:
            yield begin, int(ends[upto - 1])
            begin, at = int(ends[upto - 1]), upto
            continue
        end, low = int(ends[at]), begin
        while True:
            high = min(end, low + most)
            yield low, high
            if high == end:
                break
            low = high - LEAST + 1
        begin, at = end, at + 1


def common_prefixes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted suffix and the one before it (0 for the first)."""
    if not len(rows):
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    at = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate([[0], np.minimum(at, np.minimum(sizes[1:], sizes[:-1]))])


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, left, right) of the nodes of the common-prefix interval tree with length >= least, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i, n in enumerate([*lcp, 0]):
        left = i - 1
        while stack and stack[-1][0] > n:
            length, left = stack.pop()
            yield length, left, i - 1
        if n >= least and (not stack or stack[-1][0] < n):
            stack.append((n, left))


def maximal_repeats(strings: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(string, offset)]) of all strings of at least ``least`` bytes that occur more than once in ``strings`` and whose
    occurrences can be extended together neither to the left nor to the right. All occurrences are given."""
    repeats = []
    for length, number, offset, left, right in _repeats(strings, least):
        repeats.append((length, list(zip(number[left:right + 1].tolist(), offset[left:right + 1].tolist(), strict=True))))
    return repeats


def _repeats(strings: list[bytes], least: int):
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    longest = int(sizes.max(initial=0))
    n = np.maximum(sizes - least + 1, 0)
    if not n.sum():
        return
    number = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text = np.frombuffer(b"".join(strings) + bytes(longest), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[number] + offset
    size = sizes[number] - offset
    before = np.where(offset > 0, text[begin - 1].astype(np.int64), -1 - number)        # the start of a string differs from all
    rows = np.lib.stride_tricks.sliding_window_view(text, longest)[begin]
    rows[np.arange(longest)[None, :] >= size[:, None]] = 0
    # Rows are filled up with zeros, which the comparison ignores: of rows alike but for zeros the shorter comes first.
    order = np.argsort(size, kind="stable")
    order = order[np.argsort(rows.view(f"S{longest}").ravel()[order], kind="stable")]
    rows, number, offset, size, before = rows[order], number[order], offset[order], size[order], before[order]
    lcp = common_prefixes(rows, size)
    # Runs that share ``least`` bytes; one whose bytes before are all alike holds no maximal repeat, nor does any part of it.
    first = np.flatnonzero(lcp < least)
    alike = np.minimum.reduceat(before, first) == np.maximum.reduceat(before, first)
    width = np.diff(np.append(first, len(lcp)))
    keep = np.repeat(~alike & (width > 1), width)
    number, offset, before = number[keep], offset[keep], before[keep]
    lcp = np.where(lcp < least, 0, lcp)[keep]
    for length, left, right in intervals(lcp.tolist(), least):
        part = before[left:right + 1]
        if (part != part[0]).any():
            yield length, number, offset, left, right


def least_ids(strings: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each start in each string: the least id of the strings that hold the ``LEAST`` bytes from there."""
    out = [np.full(len(s) - LEAST + 1, i) for s, i in zip(strings, ids, strict=True)]
    for length, number, offset, left, right in _repeats(strings, LEAST):
        which = number[left:right + 1]
        low = ids[which].min()
        for s, at in zip(which.tolist(), offset[left:right + 1].tolist(), strict=True):
            part = out[s][at:at + length - LEAST + 1]
            np.minimum(part, low, out=part)
    return out


def _stretches(data: bytes, ids: np.ndarray, found, repeated: np.ndarray):
    """Repeated anchors of a block: their stretches once each, the hash and least id of each, and each anchor's stretch."""
    h, first, last, owner = (c[repeated] for c in found)
    place: dict[bytes, int] = {}
    which = np.fromiter((place.setdefault(data[a:b], len(place)) for a, b in zip(first.tolist(), (last + LEAST).tolist(), strict=True)), np.int64, len(h))
    low, own = np.full(len(place), NEVER), np.zeros(len(place), np.uint64)
    np.minimum.at(low, which, ids[owner])
    own[which] = h
    return list(place), own, low, which, first, last, owner


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_bytes, spans (removed runs as (from, upto) in bytes, maximal) and kept (remaining bytes).

    A byte goes if a string of ``LEAST`` bytes over it also starts in a document of a smaller id. A null or shorter text
    loses nothing. Rows with a null id lose nothing and take nothing from others; rows that repeat an id do not
    take from each other. Ids are whole numbers. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    packed = B.blocks(rows, F.col("id").isNotNull(), "id", "text", block_bytes)
    buckets = B.n_buckets(packed)

    def numbers(ids: list, flags: np.ndarray) -> np.ndarray:
        return np.array([i if f else NEVER for i, f in zip(ids, flags, strict=True)], np.int64)

    def dealt(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)

    def in_buckets(h: np.ndarray) -> list[np.ndarray]:
        to = dealt(h)
        order = np.argsort(to, kind="stable")
        return np.split(order, np.searchsorted(to[order], np.arange(1, buckets)))

    def hashes(ids, flags, ends, data):
        """Distinct anchors of a block, and whether two of its documents have one."""
        h, _, _, owner = anchors(np.frombuffer(data, np.uint8), ends)
        own = numbers(ids, flags)[owner]
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        last = np.append(first[1:], len(h)) - 1
        return h[first], own[first] != own[last]

    def asking(ids, flags, ends, data):
        h, several = hashes(ids, flags, ends, data)
        return [B.squeeze(h[p].astype(np.uint32).tobytes() + several[p].tobytes()) if len(p) else b"" for p in in_buckets(h)]

    def telling(payloads):
        raws = [B.loosen(p) if p else b"" for p in payloads]
        sizes = [len(r) // 5 for r in raws]
        h = np.concatenate([np.frombuffer(r[:4 * n], np.uint32) for r, n in zip(raws, sizes, strict=True)])
        several = np.concatenate([np.frombuffer(r[4 * n:], bool) for r, n in zip(raws, sizes, strict=True)])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice |= several
        cuts = np.cumsum([0, *sizes])
        return [B.squeeze(np.packbits(twice[a:b])) if b > a else b"" for a, b in zip(cuts[:-1], cuts[1:], strict=True)], None

    def repeated_of(ids, flags, ends, data, given):
        """The stretches of a block, with the answers of the first pass."""
        found = anchors(np.frombuffer(data, np.uint8), ends)
        distinct = np.unique(found[0])
        yes = np.zeros(len(distinct), bool)
        for p, g in zip(in_buckets(distinct), given, strict=True):
            if len(p):
                yes[p] = np.unpackbits(np.frombuffer(B.loosen(g), np.uint8))[:len(p)].astype(bool)
        repeated = yes[np.searchsorted(distinct, found[0])] if len(distinct) else np.zeros(0, bool)
        return _stretches(data, numbers(ids, flags), found, repeated)

    second = arrow_schema("bucket int, block long, payload binary")

    def sending(ids, flags, ends, data, given):
        strings, h, low, *_ = repeated_of(ids, flags, ends, data, given)
        parts = []
        for p in in_buckets(h):
            text = [strings[i] for i in p]
            parts.append(B.squeeze(len(p).to_bytes(8, "little") + h[p].tobytes() + low[p].tobytes() + np.fromiter(map(len, text), np.uint8, len(p)).tobytes() + b"".join(text)) if len(p) else b"")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(np.full(buckets, -1)), pa.array(parts, pa.binary())], schema=second)

    def grouping(payloads):
        place: dict[bytes, int] = {}
        lows, hashes_of, which, sizes = [], [], [], []
        for payload in payloads:
            raw = B.loosen(payload) if payload else bytes(8)
            n = int.from_bytes(raw[:8], "little")
            h, low, size = np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), np.frombuffer(raw, np.uint8, n, 8 + 16 * n)
            at = 8 + 17 * n + np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            which.append(np.fromiter((place.setdefault(raw[a:b], len(place)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64, n))
            lows.append(low)
            hashes_of.append(h)
            sizes.append(size)
        strings, all_of = list(place), np.concatenate(which)
        low, own = np.full(len(strings), NEVER), np.zeros(len(strings), np.uint64)
        np.minimum.at(low, all_of, np.concatenate(lows))
        own[all_of] = np.concatenate(hashes_of)
        ids: list[np.ndarray | None] = [None] * len(strings)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
        held: list[int] = []
        weight = 0

        def settle():
            for i, d in zip(held, least_ids([strings[i] for i in held], low[held]), strict=True):
                ids[i] = d

        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a == 1:              # the one stretch of its anchor: every string in it has the same documents
                ids[order[a]] = np.full(len(strings[order[a]]) - LEAST + 1, low[order[a]])
                continue
            held += order[a:b].tolist()
            weight += sum(len(strings[i]) - LEAST + 1 for i in order[a:b].tolist())
            if weight > SUFFIXES:
                settle()
                held, weight = [], 0
        if held:
            settle()
        return [B.squeeze(np.concatenate([ids[i] for i in w.tolist()])) if len(w) else b"" for w in which], None

    first = B.answer(B.ask(packed, asking, buckets), telling)
    sent = B.met(packed, first, sending, "bucket int, block long, payload binary", number="block")
    answers = B.answer(sent, grouping).withColumn("bucket", F.col("bucket") + buckets)
    result = "id long, n_bytes long, spans array<struct<from:long,upto:long>>, kept binary"
    schema = arrow_schema(result)

    def clearing(ids, flags, ends, data, given):
        strings, h, _, which, begin, last, owner = repeated_of(ids, flags, ends, data, given[:buckets])
        sizes = np.fromiter((len(s) - LEAST + 1 for s in strings), np.int64, len(strings))
        start = np.zeros(len(strings), np.int64)
        flat, total = [], 0
        for p, g in zip(in_buckets(h), given[buckets:], strict=True):
            if len(p):
                flat.append(np.frombuffer(B.loosen(g), np.int64))
                start[p] = total + np.cumsum(sizes[p]) - sizes[p]
                total += int(sizes[p].sum())
        low = np.concatenate(flat) if flat else np.empty(0, np.int64)
        n = last - begin + 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = low[np.repeat(start[which], n) + step] < np.repeat(numbers(ids, flags)[owner], n)
        gone &= np.repeat(np.array(flags, bool)[owner], n)
        at = (np.repeat(begin, n) + step)[gone]
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + LEAST, -1)
        removed = np.cumsum(edge[:-1]) > 0
        bounds, spans, kept, plain = np.concatenate([[0], ends]), [], [], np.frombuffer(data, np.uint8)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = removed[a:b]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]))).reshape(-1, 2)
            spans.append([{"from": x, "upto": y} for x, y in turns.tolist()])
            kept.append(plain[a:b][~part].tobytes() if len(turns) else data[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(spans, schema.field(2).type), pa.array(kept, pa.binary())], schema=schema)

    return B.met(packed, first.unionByName(answers), clearing, result)
