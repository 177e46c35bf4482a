"""A hidden Markov language model trained by Baum-Welch over the whole corpus.

States emit word classes and a class emits its words, P(w | state) = P(class | state) P(w | class), so the model that every
task holds is bounded while word counts grow with the corpus. A word with at least 1 in ``COMMON`` of all tokens is a
class of its own (there cannot be more than ``COMMON`` of them); other words share classes by a hash of their last bytes. A
class of rare words gives one unseen word the same smoothed share as the base model does, so all probabilities add up to 1.

Counts of words come from block look-ups. A training round reads all class sequences once, whole; each task sums the expected
counts of its rows and an aggregate adds them up. Scoring runs the scaled forward recursion over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import arrow_schema, map_batches, small_batches, written

STATES, COMMON, RARE = 8, 2048, 2046
CLASSES = 1 + COMMON + RARE         # the end of a text is class 0
ROUNDS = 6
SEGMENT, BATCH_TOKENS, TASK_TOKENS = 1024, 600_000, 3_000_000


def coded_words(data: bytes, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a block, the code of each word in a row, and the number of words of each text."""
    starts = np.concatenate([[0], ends[:-1]])
    texts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(starts, ends[-1]).astype(np.int32)), pa.py_buffer(data)])
    low = pc.ascii_lower(texts.cast(pa.string(), safe=False))
    for blank in "\t\n\x0b\x0c\r":
        low = pc.replace_substring(low, blank, " ")
    lists = pc.split_pattern(low, " ")
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(ends)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if b"" in words:
        keep = codes != words.index(b"")
        codes, owner = codes[keep], owner[keep]
    return words, codes, np.bincount(owner, minlength=len(ends))


def dealt(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets


def rare_class(word: bytes) -> int:
    return 1 + COMMON + zlib.crc32(word[-3:]) % RARE


def word_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """Answers with the corpus counts (flagged texts only) of each block's words, and a summary of each bucket."""

    def asking(ids, flags, ends, data):
        words, codes, n = coded_words(data, ends)
        counts = np.bincount(codes, np.repeat(flags, n), len(words)).astype(np.int64)
        to = dealt(words, buckets)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        return [B.squeeze(len(o).to_bytes(8, "little") + counts[o].astype("<i8").tobytes() + b"\n".join([words[i] for i in o])) if len(o) else b""
                for o in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]

    def answering(payloads):
        lists, counts = [], []
        for p in payloads:
            raw = B.loosen(p) if p else bytes(8)        # the number of words, their counts, and the words, one a line
            n = int.from_bytes(raw[:8], "little")
            counts.append(np.frombuffer(raw[8:8 + 8 * n], "<i8"))
            lists.append(raw[8 + 8 * n:].split(b"\n") if n else [])
        flat = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
        words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(codes, np.concatenate(counts), len(words)).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        given = [B.squeeze(total[codes[a:b]]) if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
        own = np.fromiter((rare_class(w) for w in words), np.int64, len(words))
        share = np.stack([np.bincount(own, total, CLASSES), np.bincount(own, total > 0, CLASSES)]).astype(np.int64)
        common = np.flatnonzero(total * COMMON >= max(total.sum(), 1))
        tail = b"\n".join(b"%d %s" % (total[i], words[i]) for i in common if words[i])
        return given, B.squeeze(share.tobytes() + tail)

    return B.answer(B.ask(packed, asking, buckets), answering)


def class_totals(answers: DataFrame) -> np.ndarray:
    """Tokens and distinct words of each class by suffix, summed over the summaries of all buckets."""
    schema = arrow_schema("cell int, n long, v long")

    def run(batches):
        sums = np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                sums += np.frombuffer(B.loosen(raw)[:16 * CLASSES], np.int64).reshape(2, CLASSES)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])], schema=schema)

    rows = answers.where("block < 0").select("payload").mapInArrow(run, "cell int, n long, v long")
    share = np.zeros((2, CLASSES), np.int64)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():      # at most CLASSES rows
        share[:, r.cell] = r.n, r.v
    return share


def common_words(answers: DataFrame, total: int) -> dict[bytes, int]:
    """Words with at least 1 in COMMON of ``total`` tokens and their counts; there are at most COMMON of them."""
    schema = arrow_schema("word binary, n long")

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                lines = [x.partition(b" ") for x in B.loosen(raw)[16 * CLASSES:].split(b"\n") if x]
                kept = [(w, int(c)) for c, _, w in lines if int(c) * COMMON >= total]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([c for _, c in kept], pa.int64())], schema=schema)

    return {bytes(r.word): r.n for r in answers.where("block < 0").select("payload").mapInArrow(run, "word binary, n long").collect()}


def expected(classes: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, segment: int = SEGMENT,
             kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first states, moves and emitted classes over whole sequences, and their log likelihood (natural).

    Forward messages are kept at the beginning of every ``segment`` steps only and made again when the backward recursion
    comes to them, so a very long sequence takes no more room than a segment and one message for each.
    """
    k, given, start, move = len(start), np.ascontiguousarray(emit.T, kind), start.astype(kind), move.astype(kind)
    n = np.array([len(c) for c in classes])
    order = np.argsort(-n, kind="stable")
    n = n[order]
    flat, steps = np.concatenate([classes[i] for i in order]), int(n[0])
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    active = np.searchsorted(-n, -np.arange(1, steps + 1), "right").tolist()

    def onward(a: np.ndarray | None, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = active[t]
        seen = given[flat[first[:m] + t]]
        a = (start if t == 0 else a[:m] @ move) * seen
        s = a.sum(1)
        return a / s[:, None], s, seen

    kept: list[np.ndarray | None] = [None]
    a = None
    for t in range((steps - 1) // segment * segment):
        a = onward(a, t)[0]
        if (t + 1) % segment == 0:
            kept.append(a)
    moves, beta, emitted, log = np.zeros((k, k)), np.ones((len(n), k), kind), np.zeros((k, emit.shape[1])), 0.0
    for lo in range((steps - 1) // segment * segment, -1, -segment):
        before, told, a = kept.pop(), [], None
        a = before
        for t in range(lo, min(lo + segment, steps)):
            told.append(onward(a, t))
            a = told[-1][0]
        gammas = []
        for t in range(min(lo + segment, steps) - 1, lo - 1, -1):
            alpha, s, seen = told[t - lo]
            m = active[t]
            gammas.append(alpha * beta[:m])
            if t:
                ahead = seen * beta[:m] / s[:, None]
                moves += (told[t - lo - 1][0] if t > lo else before)[:m].T @ ahead
                beta[:m] = ahead @ move.T
        at = np.concatenate([flat[first[:active[t]] + t] for t in range(min(lo + segment, steps) - 1, lo - 1, -1)])
        weight = np.concatenate(gammas)
        emitted += np.stack([np.bincount(at, weight[:, i], emit.shape[1]) for i in range(k)])
        log += float(np.log(np.concatenate([s for _, s, _ in told]), dtype=np.float64).sum())
    return gammas[-1].sum(0, dtype=np.float64), moves * move, emitted, log


def forward(classes: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of each sequence by the scaled forward recursion."""
    n = np.array([len(c) for c in classes])
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    flat = np.concatenate([classes[i] for i in order])
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right").tolist()
    given, total = np.ascontiguousarray(emit.T), np.zeros(len(n))
    a = np.empty((0, len(start)))
    for t, m in enumerate(active):
        a = (start if t == 0 else a[:m] @ move) * given[flat[first[:m] + t]]
        s = a.sum(1)
        total[:m] += np.log10(s)
        a = a / s[:, None]
    out = np.empty(len(n))
    out[order] = total
    return out


def train(sequences: DataFrame, prior: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = 5):
    """start, move and emit after Baum-Welch rounds, each over all rows of ``sequences`` (classes, train) that train."""
    rng = np.random.default_rng(seed)
    size = len(prior)
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    emit = prior * np.exp(rng.standard_normal((states, size)))
    emit /= emit.sum(1, keepdims=True)
    schema = arrow_schema("cell int, v double")
    cells = states + states * states + states * size
    rows = sequences.where("train").select("classes")

    def one_round(start, move, emit):
        def counted(held: list[np.ndarray]) -> np.ndarray:
            """Counts of the held sequences; those of like length go together, so that few steps are narrow."""
            sums, batch, tokens = np.zeros(cells), [], 0
            held.sort(key=len, reverse=True)
            for i, seq in enumerate(held):
                batch.append(seq)
                tokens += len(seq)
                if tokens > BATCH_TOKENS or i == len(held) - 1:
                    first, moves, emitted, _ = expected(batch, start, move, emit, kind=np.float32)
                    sums += np.concatenate([first, moves.ravel(), emitted.ravel()])
                    batch, tokens = [], 0
            return sums

        def run(batches):
            sums, held, tokens = np.zeros(cells), [], 0
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    held.append(np.frombuffer(raw, np.uint16))
                    tokens += len(held[-1])
                    if tokens > TASK_TOKENS:
                        sums += counted(held)
                        held, tokens = [], 0
            sums += counted(held)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], schema=schema)

        got = rows.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
        sums = np.zeros(cells)
        sums[got.cell.to_numpy(np.int64)] = got.v.to_numpy()
        return sums

    for _ in range(rounds):
        sums = one_round(start, move, emit)
        first, moves, emitted = sums[:states], sums[states:states + states * states].reshape(states, states), sums[states + states * states:].reshape(states, size)
        start = (first + 1) / (first + 1).sum()
        move = (moves + 1) / (moves + 1).sum(1, keepdims=True)
        emit = (emitted + 50 * prior) / (emitted.sum(1, keepdims=True) + 50)
    return start, move, emit


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10, whole text with its end).

    The model and the counts come from documents where ``held_out`` is not true. Words lie between ASCII white space, A-Z in
    lower case. A null or empty text is the end alone. Rows that repeat an id are documents of their own. Without training
    texts every count is 0. Other columns are not read; an empty table gives no rows.
    """
    packed = B.blocks(docs, ~F.coalesce(held_out, F.lit(False)), id_column, text_column)
    buckets = B.n_buckets(packed)
    answers = word_counts(packed, buckets)
    share = class_totals(answers)
    texts = packed.select(F.sum(F.size(F.filter("flags", lambda f: f)))).first()[0] or 0
    total, distinct = int(share[0].sum()) + texts, int(share[1].sum()) + (texts > 0)
    common = common_words(answers, total)
    place = {w: 1 + i for i, w in enumerate(sorted(common))}
    for w, c in common.items():
        share[:, rare_class(w)] -= (c, 1)
        share[0, place[w]] = c
    share[0, 0] = texts
    prior = (share[0] + 1) / (share[0] + 1).sum()
    inside = np.log10(share[0] + share[1] + 1.0)           # log10 of a rare class's smoothed total
    kind = dict(docs.dtypes)[id_column]
    ddl = f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, word_score double, classes binary"
    schema = arrow_schema(ddl)
    base_total = np.log10(float(total + distinct + 1))

    def sequences(ids, flags, ends, data, given) -> Iterator[pa.RecordBatch]:
        words, codes, n_words = coded_words(data, ends)
        to = dealt(words, buckets)
        order = np.argsort(to, kind="stable")
        counts = np.empty(len(words), np.int64)
        counts[order] = np.concatenate([np.frombuffer(B.loosen(g), np.int64) for g in given if g]) if len(words) else 0
        own = np.fromiter((place.get(w) or rare_class(w) for w in words), np.int64, len(words))
        known, plus = counts > 0, np.log10(counts + 1.0)
        inner = np.where(own <= COMMON, 0.0, plus - inside[own])
        cuts = np.concatenate([[0], np.cumsum(n_words)])
        owner = np.repeat(np.arange(len(ends)), n_words)
        n_known, base, word = (np.bincount(owner, x[codes], len(ends)) for x in (known, plus, inner))
        seq = own[codes].astype(np.uint16)
        end = np.zeros(1, np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, schema.field(0).type), pa.array(flags), pa.array(n_words + 1), pa.array(n_known.astype(np.int64) + int(texts > 0)),
             pa.array(base + np.log10(texts + 1.0) - (n_words + 1) * base_total), pa.array(word),
             pa.array([seq[a:b].tobytes() + end for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=schema)

    table = written(B.met(packed, answers, sequences, ddl))
    start, move, emit = train(table, prior, states, rounds)
    small_batches(docs.sparkSession)
    result = f"{id_column} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out_schema = arrow_schema(result)

    def scored(batch):
        seqs = [np.frombuffer(raw, np.uint16).astype(np.int64) for raw in batch.column(6).to_pylist()]
        likely = forward(seqs, start, move, emit)
        return pa.RecordBatch.from_arrays([batch.column(0), pc.invert(batch.column(1)), batch.column(2), batch.column(3), pa.array(np.full(batch.num_rows, total)),
                                           batch.column(4), pa.array(likely + np.array(batch.column(5)))], schema=out_schema)

    return map_batches(table.select("id", "train", "n_tokens", "n_known", "base_score", "word_score", "classes"), scored, result)
