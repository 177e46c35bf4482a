"""Packing by sums of squares, spelling variants and whitening against plain versions, and odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("panelspan.llm")
import pyarrow as pa  # noqa: E402

from panelspan.llm import squares, variants, whitening  # noqa: E402
from panelspan.llm.queries import tokenizer_path  # noqa: E402
from panelspan.llm.tokens import ByteTokens  # noqa: E402

ODD = ["a", "b", "Z", "é", "1", "2", ".", "!", "'s", "'", "’", " ", " ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "\x0b", " ",
       "<|endoftext|>", "\x00", "日本", "🙂", "​", "\r\n", "٣", "ñ"]


def byte_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_chunks_have_the_ids_of_whole_texts():
    rng, plain = random.Random(1), byte_tokenizer()
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(3000)), "x" * 5000]
    tokens = ByteTokens(tokenizer_path("byte_bpe_50k.json"))
    for again in range(2):          # encoded, then looked up
        ids, bounds = tokens.ids(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, (again, t)


def plain_squares(lengths, window):
    """The rule by itself: every gap tried, sums of squares counted in full."""
    open_windows, used, room, left, out = {}, 0, 0, sum(lengths), []
    for s in lengths:
        options = []
        for gap in [*sorted(g for g in open_windows if open_windows[g] and g >= s), window]:
            n = {g: len(w) for g, w in open_windows.items()}
            if gap < window:
                n[gap] -= 1
            if 0 < gap - s < window:
                n[gap - s] = n.get(gap - s, 0) + 1
            options.append((sum(k * k for k in n.values()), gap))
        if room >= left and len(options) > 1:
            options = [o for o in options if o[1] < window]
        gap = min(options)[1]
        number = used if gap == window else open_windows[gap].pop()
        if gap == window:
            used, room = used + 1, room + window
        if gap > s:
            open_windows.setdefault(gap - s, []).append(number)
        out.append((number, window - gap))
        room, left = room - s, left - s
    return out, used


def test_place_takes_the_smallest_sum_of_squares():
    rng = np.random.default_rng(3)
    for window in (1, 2, 7, 64):
        for n in (0, 1, 300):
            lengths = -np.sort(-rng.integers(1, window + 1, n))
            numbers, offsets, used = squares.place(lengths, window)
            assert (list(zip(numbers.tolist(), offsets.tolist(), strict=True)), used) == plain_squares(lengths.tolist(), window)


def test_square_packing(spark):
    rng = random.Random(5)
    prose = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts = [*prose, None, "", " \n", prose[0], "<|endoftext|> and <|endoftext|>", " ".join(prose[:60]), "\x00 odd"]
    rows = [(i, t, 1, "clash", 2) for i, t in enumerate(texts)] + [(None, "no id", 1, "clash", 2), (3, prose[3], 1, "clash", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int, ids string, pool int").repartition(5)
    plain = byte_tokenizer()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) if len(ids) <= 64 else (len(ids) - 1) % 64 + 1
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    for pool in (50, 100_000):
        got = squares.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=64, pool=pool).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in places.values():
            p.sort()
            assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 64
        least = -(-sum(r.length for r in got) // 64)
        assert len(places) <= least * (1.12 if pool == 50 else 1.02) + 1
    assert squares.pack(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).collect() == []
    with pytest.raises(ValueError):
        squares.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=0)


def edits(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words, factor=2):
    out = {}
    for w, n in words.items():
        near = [u for u in words if edits(w, u)]
        best = min(near, key=lambda u: (-words[u], u), default=None)
        out[w] = (best if best is not None and words[best] >= factor * n else None, n, len(near))
    rows = {}
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows[w] = (form, root, n, k, words[form] if form is not None else None)
    return rows


def test_variants_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(250)]
    words = {w: rng.choice([1, 1, 2, 3, 4, 8, 8, 30, 100]) for w in [*base, "aaaaa", "aaaa", "aaaaaa", "a" * 200, "a" * 199 + "b", "a" * 199, "ÿ", ""]}
    rows = [(w, n, "x") for w, n in words.items()] + [(None, 4, "x"), ("nocount", None, "x")]
    got = variants.spelling_variants(spark.createDataFrame(rows, "word string, n int, form string")).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(words) and len(got) == len(words)
    assert variants.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame(rows, "word string, n int, form string"), factor=1)


def test_word_counts_of_texts(spark):
    import re
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Spelling", "spellIng", "Écolière", "écolière", "ab", "x1letters2more", "naïve-words", "×÷×÷×"]) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "c") for i, t in enumerate([*texts, None, "", "12 34", "q" * 9000, "q" * 9000, "q" * 9000])] + [(None, texts[0], "c"), (1, texts[1], "c")]
    for divisor in (None, 7):
        want = Counter()
        for i, t, _ in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if divisor and h % divisor == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                want[run] += len(run) >= 5
        got = variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string, n string"), divisor).collect()
        assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if n >= 3} and len(got) == len({r.word for r in got})


def plain_whitening(vectors, k):
    x = np.array([[int(np.floor(256 * c)) for c in v] for v in vectors])
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(0)
    c = u - sums / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return (x - sums / n) @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), ((n * x - sums) ** 2).sum(1), n


def test_whitening_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    dense = rng.standard_normal((300, 12)) * np.linspace(3, 0.5, 12) + 5
    vectors = [v.tolist() for v in np.vstack([dense, dense[:40]])]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, [])]
    schema = "vec_id long, embedding array<double>, x string, component int, n string"
    rows = [(i, v, "c", 1, "c") for i, v in [*enumerate(vectors), *odd]] + [(None, vectors[0], "c", 1, "c"), (5, vectors[7], "c", 1, "c")]
    got = whitening.whiten(spark.createDataFrame(rows, schema).repartition(4)).collect()
    want, shares, deviation, n = plain_whitening(vectors, 4)
    assert len(got) == 4 * (len(vectors) + 2) and {r.n for r in got} == {n} == {300}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component, r.deviation] = r.whitened
    sign = {c: np.sign(want[0][c - 1] * next(v for (k, _), v in by[0].items() if k == c)) for c in range(1, 5)}
    for i in set(range(len(vectors))) - {5}:
        for (c, d), v in by[i].items():
            assert d == deviation[i] and abs(v * sign[c] - want[i][c - 1]) < 1e-9
    assert len(by[5]) == 8 and len(by[None]) == 4
    for r in got:
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []      # no deviation
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], schema)).collect()
    assert {r.component for r in line} == {1} and len(line) == 5 and all(abs(r.explained - 1) < 1e-12 for r in line)
    # Equal eigenvalues: any basis of their space will do, and the covariance tells that all of it was found.
    axes = [(0, 3.0), (0, -3.0), (1, 1.0), (1, -1.0), (2, 1.0), (2, -1.0), (3, 1.0), (3, -1.0)]
    cross = whitening.whiten(spark.createDataFrame([(i, [x if a == k else 0.0 for k in range(6)]) for i, (a, x) in enumerate(axes)], schema)).collect()
    assert len(cross) == 32 and {round(r.explained, 9) for r in cross} == {0.75, round(1 / 12, 9)} and cross[0].identity_error < 1e-9
    # Two lengths are two tables; entries beyond a long are held to its range, deviations beyond it are null.
    mixed = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, [5.0]), (5, [1e300]), (6, [-1e300])]
    got = whitening.whiten(spark.createDataFrame(mixed, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n) for r in got} == {(1, 2), (2, 2), (3, 4), (4, 4), (5, 4), (6, 4)}
    assert all((r.deviation is None) == (r.vec_id in (5, 6)) for r in got if r.n == 4) and all(r.deviation == 2 * 256 ** 2 for r in got if r.n == 2)
