"""Dealt operators on small tables: brute force, and rows with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("panelspan.llm")
from panelspan.llm import hmm, lines, mixing, neighbours, pack, quality, simhash, suffixes, toxicity, vectors  # noqa: E402
from panelspan.llm.common import components  # noqa: E402
from panelspan.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label int, keep string, rate string, runs int, n_runs int, fp string, block int, host string"


def words(rng, n, prefix=""):
    return " ".join(prefix + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [words(rng, 60) + "\n" + words(rng, 30) + "\n\n" + words(rng, 20) for _ in range(12)]
    near = [base[0].replace(base[0].split()[40], "changed"), base[1] + " more", base[2].upper()]
    shared = words(rng, 55)
    return [*base, *near, base[3], base[3], None, "", " \n\t", "x", words(rng, 20000), words(rng, 10) + " " + shared, shared + " " + words(rng, 12),
            "same same " * 300, "first line here\nsecond line here\nthird", "zero\nfirst line here\n\n  second line here \nlast", "<|endoftext|> \x01 it's 42's", "a <|endoftext|> b<|startoftext|>C <|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or ""), "clash", 1, "k", "r", 2, 3, "f", 4, "h") for i, t in enumerate(texts)]
    rows += [(None, "null id " * 20, None, None, None, None, None, None, None, None, None, None, None, None), rows[4], rows[4]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(len(texts))] + [(None, 1, 1), (2, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


def ids(rows, column="doc_id"):
    return sorted(((r[column] is None, r[column]) for r in rows), key=str)


def same_ids(rows, docs, column="doc_id"):
    assert ids(rows, column) == ids(docs.select("doc_id").collect())


def test_pack(docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    got = pack.pack(docs, tokenizer_path(), window=128, batch_tokens=3000).collect()
    want = Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.select("doc_id", "text").collect())
    places = {}
    for r in got:
        assert 0 < r.length <= 128 and r.length == len(r.ids) // 4
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 128
    pieces = Counter((r.doc_id, r.start, r.ids) for r in got)
    expected = Counter()
    for (doc, seq), n in want.items():
        data = np.array(seq, "<u4").tobytes()
        for s in range(0, len(seq), 128):
            expected[doc, s, bytes(data[4 * s:4 * (s + 128)])] += n
    assert Counter({(d, s, bytes(i)): n for (d, s, i), n in pieces.items()}) == expected
    assert sum(r.length for r in got) / (128 * len(places)) > 0.97


def test_pack_of_an_empty_table(docs):
    assert pack.pack(docs.limit(0), tokenizer_path()).collect() == []


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 400)
    bins, offsets, used = pack.best_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            room[room.index(min(fits))] -= sizes[i]
        else:
            room.append(100 - sizes[i])
    loads = np.bincount(bins, sizes, used)
    assert used == len(room) and sorted(100 - loads) == sorted(room) and loads.max() <= 100


def test_toxicity(docs, labels, spark):
    from pyspark.sql import functions as F
    rng = random.Random(2)
    rows = [(i, words(rng, 80) + (" you vileword person " if i % 4 == 0 else " ") + words(rng, 40), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights, bias = toxicity.fit(table, toxicity.labelled_sample(table, "toxic", F.col("doc_id") < 300, 250))
    late = toxicity.score(table, weights, bias).where("doc_id >= 300").collect()
    assert len(late) == 100 and sum((r.score >= 0.3) != (r.doc_id % 4 == 0) for r in late) <= 15       # 250 texts of random letters teach little more
    got = toxicity.score(docs, *toxicity.fit(docs, toxicity.labelled_sample(labels, "toxic", F.lit(True), 100))).collect()
    same_ids(got, docs)
    assert all(0 <= r.score <= 1 for r in got)
    one_class = toxicity.fit(docs, toxicity.labelled_sample(labels.where("toxic = 0"), "toxic", F.lit(True), 100))
    assert not one_class[0].any() and one_class[1] < 0
    assert toxicity.score(docs.limit(0), weights, bias).count() == 0


def test_quality(docs, labels, spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        good = i % 3 > 0
        text = words(rng, 60) if good else " ".join(w + "###" for w in words(rng, 60).split())
        rows.append((i, text if i != 7 else "a b", "p", "bad" if not good and i < 300 else f"host{i % 4}", 0))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = table.selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) quality").where("doc_id < 400")
    got = {r.doc_id: r for r in quality.judge(table, marks).collect()}
    assert all(got[i].keep == (i % 3 > 0) for i in range(600) if i != 7)
    assert got[0].host_rate < 0.2 < 0.6 < got[4].host_rate
    odd = quality.judge(docs, labels)
    same_ids(odd.collect(), docs)
    assert odd.where("p_good is null or p_good < 0 or p_good > 1 or keep is null").count() == 0
    assert quality.judge(docs, labels.limit(0)).where("p_doc <> 0.5").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_shrinkage_follows_the_spread_of_the_sites(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(8)
    apart = [(int(n), float(rng.binomial(n, r))) for n, r in zip(rng.integers(20, 60, 60), rng.beta(2, 2, 60), strict=True)]
    alike = [(int(n), float(rng.binomial(n, 0.5))) for n in rng.integers(20, 60, 60)]
    wide, tight = (quality.strength(spark.createDataFrame([(float(n), s) for n, s in x], "n double, s double"), F.lit(0.5)) for x in (apart, alike))
    assert 2 < wide < 9 and tight > 30


def brute_fingerprint(text, k):
    import xxhash
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def reachable(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, texts):
    got = simhash.near_duplicates(docs).collect()
    same_ids(got, docs)
    fps = {i: brute_fingerprint(t, 4) for i, t in enumerate(texts)}
    assert all(r.fp % (1 << 64) == fps[r.doc_id] for r in got if r.doc_id is not None)
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    root = reachable(pairs, fps)
    assert all(r.component_id == root[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_covering_finds_all_links_of_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 16)
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    fps = dict(enumerate(sorted(fps)))
    table = spark.createDataFrame([(simhash._signed(f), i) for i, f in fps.items()], "fp long, id long")
    found = {r.id: r.component for r in components(simhash.near_links(table, 4)).collect()}
    root = reachable([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], fps)
    assert all(found.get(i, i) == root[i] for i in fps)
    for radius in (1, 3, 4, 6):
        family = simhash.masks(radius)
        assert all(any(not d & m for m in family) for d in (sum(1 << b for b in rng.sample(range(64), radius)) for _ in range(500)))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_one_of_each_stays(docs, texts):
    kept = [r.doc_id for r in simhash.keep_one_of_each(docs).select("doc_id").collect()]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    root = reachable(pairs, sets)
    want = [i for i in sets if root[i] == i] + [4, 4, None]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def one_of_each_by_brute_force(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = reachable([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets)
    return sorted(i for i in sets if root[i] == i)


@pytest.mark.parametrize("chunk", [1024, 4])
def test_similar_texts_of_a_template_meet(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(7)
    frame = [words(rng, 12).split() for _ in range(12)]
    rows = []
    for i in range(40):             # one long frame, own words in between: most pairs are not similar, some later ones are
        rows.append(" ".join(w for part in frame for w in [*part, words(rng, 1)]))
    rows += [r.replace(r.split()[6], "changed") for r in rows[20:30]]
    sentences = [words(rng, 8) for _ in range(20)]
    orders = [rng.sample(sentences, 20) for _ in range(6)]                            # one set of words, other orders
    rows += [" ".join(o) for o in orders] + [" ".join([*o[:-2], o[-1], o[-2]]) for o in orders]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == one_of_each_by_brute_force(rows)


@pytest.mark.parametrize("kind", ["appended", "truncated", "scattered"])
def test_every_copy_of_at_least_the_similarity_goes(spark, kind):
    rng = random.Random(kind)
    rows, bands = [], Counter()
    for n in (60, 150, 400):
        for k in range(60):
            base = words(rng, n).split()
            changed = round(n * rng.uniform(0.02, 0.28))
            if kind == "scattered":
                copy = base[:]
                for at in rng.sample(range(n), max(1, changed // 6)):
                    copy[at] = "changed"
            else:
                copy = [*base, *words(rng, changed).split()] if kind == "appended" else base[:n - changed]
            rows += [" ".join(base), " ".join(copy)]
            a, b = shingles(rows[-1]), shingles(rows[-2])
            bands[int(20 * len(a & b) / len(a | b))] += 1
    rows = list(enumerate(rows))
    assert min(bands[b] for b in (16, 17, 18)) >= 10                                  # 0.80, 0.85 and 0.90 up
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == one_of_each_by_brute_force(rows)


def test_lines(docs, texts):
    got = lines.remove_repeated_runs(docs).collect()
    same_ids(got, docs)
    cleared = {r.doc_id: r for r in got}
    assert cleared[15].n_removed == 4 and cleared[15].text == "" and cleared[16].text == ""        # copies of document 3
    assert cleared[3].n_removed == 0 and cleared[4].n_removed == 0                                      # first; equal rows are one
    n = texts.index("first line here\nsecond line here\nthird")
    assert cleared[n + 1].text == "zero\nlast" and cleared[n + 1].n_runs == 1 and cleared[n].text == texts[n]
    assert cleared[texts.index(None)].text is None and cleared[texts.index("x")].text == "x" and cleared[0].label == 1
    assert lines.remove_repeated_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3])
def test_lines_against_all_windows(spark, window):
    import duckdb
    rng = random.Random(window)
    rows = [(i, "\n".join(rng.choice(["a", "b", " c ", "", "d", "e"]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    want = {r[0]: r[1:] for r in con.execute(lines.repeated_lines_sql(window)).fetchall()}
    for r in lines.remove_repeated_runs(documents, window).collect():
        assert want[r.doc_id] == (r.n_lines, r.n_removed, r.n_runs, hashlib.md5(r.text.encode()).hexdigest())


@pytest.mark.parametrize("window", [2, 3])
def test_long_single_lines_that_repeat_go(spark, window):
    rng = random.Random(window)
    choice = [words(rng, 51), words(rng, 80).replace(" ", " \t"), words(rng, 50), words(rng, 300), "a", " b ", "", "c", "d"]
    rows = [(0, choice[0]), (1, f"  {choice[0]} "), (2, choice[2]), (3, choice[2])]
    rows += [(i, "\n".join(rng.choice(choice) for _ in range(rng.randint(0, 9)))) for i in range(4, 120)]
    seen, want = set(), {}
    for i, text in rows:
        full = [(k, x.strip()) for k, x in enumerate(text.split("\n")) if x.strip()]
        gone = set()
        for at in range(len(full)):
            for size in (1, window):
                part = tuple(x for _, x in full[at:at + size])
                if len(part) == size and (size == window or len(part[0].split()) > 50):
                    if part in seen:
                        gone.update(range(at, at + size))
                    seen.add(part)
        runs = [[k] for k in sorted(gone) if k - 1 not in gone]
        cut = {line for (a,) in runs for b in [next(b for b in range(a, len(full)) if b + 1 not in gone)] for line in range(full[a][0], full[b][0] + 1)}
        want[i] = (len(runs), "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut))
    got = lines.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), window, long_words=50).collect()
    assert {r.doc_id: (r.n_runs, r.text) for r in got} == want
    assert want[1] == (1, "") and want[3] == (0, choice[2])


def vector_rows(rng):
    base = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in base[i % 6] + 0.05 * rng.standard_normal(16)], i % 2) for i in range(60)]
    rows += [(60, None, 1), (61, [0.0] * 16, 1), (62, [float("nan")] * 16, 1), (63, [1.0] * 15 + [None], 1), (64, rows[0][1], None), (65, rows[0][1], 0), (66, rows[0][1], 0),
             (67, [1.0, 2.0], 0), (68, [2.0, 4.0], 0), (None, rows[0][1], 0), (69, [], 1), (70, [1e200] * 16, 0), (71, [2e200] * 16, 0), (66, rows[2][1], 0)]
    return rows


def cosine(a, b):
    a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_vectors(spark):
    rows = vector_rows(np.random.default_rng(1))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as rep", "'x' as weight")
    good = [(n, r) for n, r in enumerate(rows) if fine(r[1]) and r[2] is not None and r[0] is not None]
    links, pairs = Counter(), []
    for n, a in good:
        for m, b in good:
            if n < m and a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93:
                links[n] += 1
                links[m] += 1
                pairs.append((a[0], b[0]))
    root = reachable(pairs, {r[0] for r in rows if r[0] is not None})
    want = sorted(str((r[0], links[n], root.get(r[0]), r[0] is not None and root[r[0]] == r[0])) for n, r in enumerate(rows))
    for chunk in (1024, 4):
        got = vectors.near_duplicates(table, chunk=chunk).collect()
        assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_neighbours(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(32)]) for i in range(1500)]
    rows += [(1500 + i, rows[20][1]) for i in range(8)] + [(1600, None), (1620, [0.0] * 32), (1640, [float("inf")] * 32), (1660, [1.0]), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as list")
    got = neighbours.search(table, F.col("vec_id") % 20 == 0, k=5, chunk=200, query_block=16).collect()
    good = [r for r in rows if r[0] is not None and fine(r[1]) and len(r[1]) == 32]
    x, number = np.array([r[1] for r in good]), np.array([r[0] for r in good])
    hits, queries = 0, [i for i in number if i % 20 == 0]
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == sorted(queries)
    for q in queries:
        v = x[number == q][0]
        c = x @ v / np.sqrt((x * x).sum(1) * (v @ v))
        c[number == q] = -9
        best = np.lexsort((number, -np.round(c, 12)))[:5]
        mine = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(c[number == r.vec_id][0] - r.score) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(number[best].tolist()))
    assert hits >= 0.93 * 5 * len(queries)
    assert [r.vec_id for r in sorted(by[20], key=lambda r: r.rank)] == [1500, 1501, 1502, 1503, 1504]
    few = neighbours.search(table.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2 and neighbours.search(table.limit(0), F.lit(True)).count() == 0


def test_hmm_counts_and_probabilities(docs, texts):
    from pyspark.sql import functions as F
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    got = hmm.score(docs, held).collect()
    same_ids(got, docs)
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in docs.select("doc_id", "text").collect()]
    c = Counter(w for i, ws in rows if i is None or i % 5 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = next(ws for i, ws in rows if i == r.doc_id)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n) and abs(r.base_score - base) < 1e-6 * max(1, -base)
        assert r.score < 0 and r.held_out == (r.doc_id is not None and r.doc_id % 5 == 0)
    assert hmm.score(docs.limit(0), held).count() == 0
    none = hmm.score(docs.where("doc_id < 3"), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in none)


def test_forward_and_counts_by_enumeration():
    from itertools import product
    rng = np.random.default_rng(3)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3)
    seqs = [np.array(s) for s in ([0, 3, 4, 1], [2], [1, 1, 0])]
    first, moves, emitted, total = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0
    for s, log in zip(seqs, hmm.forward(seqs, start, move, emit), strict=True):
        paths = {p: start[p[0]] * np.prod([emit[k, o] for k, o in zip(p, s, strict=True)]) * np.prod([move[a, b] for a, b in zip(p, p[1:], strict=False)]) for p in product(range(3), repeat=len(s))}
        whole = sum(paths.values())
        assert abs(log - math.log10(whole)) < 1e-12
        total += math.log(whole)
        for p, w in paths.items():
            first[p[0]] += w / whole
            for a, b in zip(p, p[1:], strict=False):
                moves[a, b] += w / whole
            for k, o in zip(p, s, strict=True):
                emitted[k, o] += w / whole
    for segment in (1, 2, 3, 100):
        got = hmm.expected(seqs, start, move, emit, segment=segment)
        assert all(np.allclose(a, b) for a, b in zip(got, (first, moves, emitted, total), strict=True))
    rough = hmm.expected(seqs, start, move, emit, kind=np.float32)
    assert all(np.allclose(a, b, rtol=1e-4, atol=1e-5) for a, b in zip(rough, (first, moves, emitted, total), strict=True))


def test_hmm_training_parts_the_states_of_a_tiny_table(spark):
    """Short texts of two kinds of words by turns: every round reads all of them, and the likelihood rises to what the turns allow."""
    rng = np.random.default_rng(1)
    seqs = [np.concatenate([(np.arange(30) + i) % 2 * 3 + rng.integers(1, 4, 30), [0]]).astype(np.uint16) for i in range(300)]
    rows = spark.createDataFrame([(bytearray(s.tobytes()), True) for s in seqs] + [(bytearray(seqs[0].tobytes()), False)], "classes binary, train boolean")
    prior = (np.bincount(np.concatenate(seqs), minlength=7) + 1) / (sum(map(len, seqs)) + 7)
    likely = []
    for rounds in (0, 2, 12, 40):
        start, move, emit = hmm.train(rows, prior, states=3, rounds=rounds)
        assert np.allclose([start.sum(), *move.sum(1), *emit.sum(1)], 1)
        likely.append(hmm.forward(seqs, start, move, emit).sum())
    assert likely == sorted(likely) and np.ptp(emit, axis=0).max() > 0.05
    assert likely[-1] > hmm.forward(seqs, np.ones(1), np.ones((1, 1)), prior[None, :]).sum() + 20


def test_suffixes(docs, texts, spark):
    seen = {}
    rows = {i: (t or "").encode() for i, t in enumerate(texts)}
    for i, b in rows.items():
        for p in range(len(b) - 49):
            seen.setdefault(b[p:p + 50], i)
    for size in (8_000_000, 3000):
        got = suffixes.remove_repeats(docs, block_bytes=size).collect()
        same_ids(got, docs, "id")
        for r in got:
            if r.id is None:
                assert not r.spans
                continue
            b = rows[r.id]
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - 49):
                if seen[b[p:p + 50]] < r.id:
                    gone[p:p + 50] = True
            assert r.n_bytes == len(b) and bytes(r.kept) == bytes(np.frombuffer(b, np.uint8)[~gone])
            turns = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int))).reshape(-1, 2).tolist()
            assert [[s["from"], s.upto] for s in r.spans] == turns
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_maximal_repeats_by_enumeration():
    rng = random.Random(5)
    for _ in range(40):
        base = bytes(rng.choice(b"ab\x00") for _ in range(40))
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) + base[rng.randint(0, 15):rng.randint(20, 40)] for _ in range(5)]
        got = {strings[occ[0][0]][occ[0][1]:occ[0][1] + n]: set(occ) for n, occ in suffixes.maximal_repeats(strings, 5)}
        held = {}
        for i, s in enumerate(strings):
            for a in range(len(s)):
                for b in range(a + 5, len(s) + 1):
                    held.setdefault(s[a:b], set()).add((i, a))
        want = {}
        for x, occ in held.items():
            left = {strings[i][a - 1] if a else (i,) for i, a in occ}
            right = {strings[i][a + len(x)] if a + len(x) < len(strings[i]) else (i,) for i, a in occ}
            if len(occ) > 1 and len(left) > 1 and len(right) > 1:
                want[x] = occ
        assert got == want


def test_long_text_is_scanned_in_overlapping_parts(monkeypatch):
    monkeypatch.setattr(suffixes, "PLACE_BITS", 10)
    rng = np.random.default_rng(9)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    ends = np.array([30, 30, 4500, 4600, 5000])
    h, first, last, owner = suffixes.anchors(data, ends)
    covered = sorted(s for a, b in zip(first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1))
    bounds = [0, *ends.tolist()]
    assert covered == [s for a, b in zip(bounds[:-1], bounds[1:], strict=True) for s in range(a, b - 49)]


def test_mixing(docs, labels, spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(5, 200), "xx" if i % 4 == 0 else "yy"), "a" if i % 4 == 0 else "b") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = table.where("doc_id < 200").select("doc_id")
    got = mixing.mix(table, marks, {"a": 1.0, "b": 1.0}).collect()
    totals = [sum(r.n_tokens * r.rate * r.posterior[k] for r in got) for k in (0, 1)]
    assert abs(totals[0] / totals[1] - 1) < 1e-4 and min(r.rate for r in got) >= 1 and all(r.posterior[r.doc_id % 4 > 0] > 0.9 for r in got)
    assert min(r.rate for r in mixing.mix(table, marks, {"a": 1.0, "b": 3.0}, budget=9000.0, least=1.0).collect()) == 1
    fixed = mixing.mix(table, marks, {"a": 3.0, "b": 1.0}, budget=8000.0).collect()
    totals = [sum(r.n_tokens * r.rate * r.posterior[k] for r in fixed) for k in (0, 1)]
    assert abs(totals[0] - 6000) < 1 and abs(totals[1] - 2000) < 1 and min(r.rate for r in fixed) >= 0
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in fixed)
    odd = mixing.mix(docs, labels, {"en": 0.5, "fr": 0.5})
    same_ids(odd.collect(), docs)
    assert odd.where("rate is null or rate < 0 or copies is null or n_tokens is null").count() == 0
    assert mixing.mix(docs.limit(0), labels, {"en": 1.0}).count() == 0
    assert {r.settled for r in got} == {r.settled for r in fixed} == {True} and max(r.off for r in got + fixed) < 1e-5
    monkeypatch.setattr(mixing, "PASSES", 1)
    left = mixing.mix(table, marks, {"a": 3.0, "b": 1.0}, budget=8000.0).collect()
    assert {r.settled for r in left} == {False} and left[0].off > 1e-4


def test_crc_of_the_contract(spark):
    from pyspark.sql import functions as F

    from panelspan.llm.common import crc32_mod
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 7 for r in spark.range(50).select("id", crc32_mod(F.col("id"), 7).alias("m")).collect())
