"""SimHash near-duplicates found with a covering family of bit masks.

Every bit of the fingerprint is dealt a vector of radius + 1 bits; mask v keeps the bits whose vector is orthogonal to v
over GF(2) (Pagh 2016). For two fingerprints that differ in at most radius bits some v is orthogonal to all the differing
bits' vectors, so the pair agrees on all bits that this mask keeps out of v: no pair within the radius is missed. Equal
fingerprints are one row from the start. In a bucket a breadth-first search takes every fingerprint out of the open set as
soon as it is linked, so a bucket of mutually close rows gives as many links as rows and never all pairs. Buckets beyond
``HOT`` rows are cut by the masks of a second, independent family (every close pair meets in one of its parts too), which
leaves few free bits and hence a bounded number of distinct fingerprints in one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, components, discard, lower_words, map_batches, small_batches, strings, written

HOT = 4096
SEED = 42


def fingerprint_of(words: list[bytes], shingle: int) -> int:
    """64-bit SimHash over the XXH64 values of word shingles, repeats included; 0 without words."""
    import xxhash
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    if len(words) <= shingle or shingle == 1:
        parts = words if shingle == 1 else [b" ".join(words)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        parts = [whole[a:b] for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist(), strict=True)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, distinct_words: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id and ``fp`` (the 64 bits as a long). A null or empty text has fingerprint 0."""
    small_batches(docs.sparkSession)
    ddl = f"{id_column} {dict(docs.dtypes)[id_column]}, fp long"
    schema = arrow_schema(ddl)

    def run(batch):
        fps = []
        for text in strings(batch.column(1)):
            words = lower_words(text)
            fps.append(fingerprint_of(sorted(set(words)) if distinct_words else words, shingle))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], schema=schema)

    return map_batches(docs.select(id_column, text_column), run, ddl)


def masks(radius: int, seed: int = SEED) -> list[int]:
    """2 ** (radius + 1) - 1 masks of kept bits. The vectors are dealt evenly, so each mask keeps about half of the bits."""
    size = 1 << (radius + 1)
    rng = np.random.default_rng(seed)
    dealt = np.concatenate([rng.permutation(size) for _ in range(-(-64 // size))])[:64]
    odd = [[bin(v & int(w)).count("1") & 1 for w in dealt] for v in range(1, size)]
    return [sum(1 << i for i, o in enumerate(row) if o) for row in odd]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints within the radius; with them every such pair is connected.

    ``fps`` has distinct ``fp`` and the smallest document ``id`` of each; links join ids, and the search in a bucket starts
    from its smallest id.
    """
    return _searched(_parts(fps, radius), radius)


def _exploded(rows: DataFrame, family: list[int], table: str, key: str, *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(family)])
    return rows.select(*keep, "fp", "id", F.explode(pairs).alias("m")).select(*keep, "fp", "id", F.col("m.t").alias(table), F.col("m.k").alias(key))


def _parts(fps: DataFrame, radius: int) -> DataFrame:
    rows = _exploded(fps.select("fp", "id"), masks(radius), "t", "k")
    sized = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("t", "k"))).where(F.col("n") > 1)
    zero = F.lit(0).cast("long")
    small = sized.where(F.col("n") <= HOT).select("t", "k", F.lit(-1).alias("t2"), zero.alias("k2"), "fp", "id")
    cut = _exploded(sized.where(F.col("n") > HOT), masks(radius, SEED + 1), "t2", "k2", "t", "k")
    return small.unionByName(cut.select("t", "k", "t2", "k2", "fp", "id"))


def _searched(parts: DataFrame, radius: int) -> DataFrame:
    keys = ["t", "k", "t2", "k2"]
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            columns = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            cuts = np.flatnonzero((columns[1:, :4] != columns[:-1, :4]).any(1)) + 1
            found = []
            for group in np.split(columns, cuts):
                key = tuple(group[0, :4])
                if key == last:
                    held.append(group[:, 4:])
                    continue
                if held:
                    found += _bucket(np.concatenate(held), radius)
                held, last = [group[:, 4:]], key
            if found:
                yield _edges(found, schema)
        found = _bucket(np.concatenate(held), radius) if held else []
        if found:
            yield _edges(found, schema)

    dealt = parts.repartition(*keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _edges(found: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    pairs = np.array(found, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)


def _bucket(rows: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one bucket; rows of (fingerprint, id) in the order of ids."""
    if len(rows) == 2:
        apart = (int(rows[0, 0]) ^ int(rows[1, 0])) & 0xFFFFFFFFFFFFFFFF
        return [(int(rows[0, 1]), int(rows[1, 1]))] if apart.bit_count() <= radius else []
    fps, ids, links = rows[:, 0].view(np.uint64), rows[:, 1], []
    left = np.arange(len(rows))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
            if near.any():
                links += [(int(ids[i]), int(ids[j])) for j in left[near]]
                queue += left[near].tolist()
                left = left[~near]
    return links


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, fp and component_id, the smallest id reachable over fingerprints within ``radius`` bits.

    Ids are whole numbers; a row with a null id keeps its fingerprint and has a null component. Repeated ids are one
    document for the component. Null and empty texts have fingerprint 0 and link like any other. Ties cannot matter. Other
    columns are not read. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, shingle, False, id_column, text_column))
    distinct = written(rows.where(F.col(id_column).isNotNull()).groupBy("fp").agg(F.min(F.col(id_column).cast("long")).alias("id")))
    same_id = rows.where(F.col(id_column).isNotNull()).join(distinct, "fp").select(F.col(id_column).cast("long").alias("a"), F.col("id").alias("b"))
    # A repeated id with other texts ties their fingerprints together.
    repeated = same_id.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where(F.col("lo") != F.col("hi")).select("a")
    tied = same_id.join(repeated, "a").select("a", "b").where(F.col("a") != F.col("b"))
    found = components(near_links(distinct, radius).unionByName(tied))
    roots = distinct.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = rows.join(roots, "fp", "left")
    return out.select(id_column, "fp", F.when(F.col(id_column).isNotNull(), F.col("component_id")).alias("component_id"))


# --- near copies by the similarity of their shingles, with fingerprints as the first search --------------------

SIMILAR, SHINGLE, SEARCH_RADIUS = 0.8, 5, 4
SLOTS = 1 << 22             # counters of shingles, and
SLOT_BLOCK = 1 << 14        # how many of them travel in one row
CHUNK = 1024                # documents of one shingle that meet in one group
SIGNS, SIGNS_SHARED = 32, 6     # two sets of similarity 0.8 share fewer of their 32 smallest hashes with probability 1e-13
HUBS = 4                    # documents of a bucket that all its others are checked with first
IDS_SENT = 2_000_000        # ids (16 MB) that are sent to all tasks rather than joined


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``shingle`` words (of the whole text if it is shorter)."""
    import xxhash
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = max(len(h) - shingle + 1, min(len(h), 1))
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    return np.unique(out)


def set_fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of hashes, each counted once; 0 of the empty set."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        set_bits += np.unpackbits(s[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(s), bitorder="little").view(np.uint64)[0])


_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, SIGNS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signs(s: np.ndarray) -> bytes:
    """One byte of the smallest hash of the set under each of SIGNS hashes; two sets share a byte about as often as they are similar."""
    least = np.full(SIGNS, np.iinfo(np.uint64).max)
    mixed = s ^ (s >> np.uint64(31))
    for at in range(0, len(s), 1 << 14):
        least = np.minimum(least, (mixed[at:at + (1 << 14), None] * _FACTORS[0]).min(0))
    return ((least * _FACTORS[1]) >> np.uint64(56)).astype(np.uint8).tobytes()


def similar_documents(docs: DataFrame, similarity: float = SIMILAR, shingle: int = SHINGLE, radius: int = SEARCH_RADIUS,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, component_id) of the documents whose component over links of shingle similarity has other members.

    Two documents are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is at least
    ``similarity`` (0.8 or more). Equal sets go through one representative each, which stands for them to the end. Pairs of
    SimHash fingerprints of the sets within ``radius`` bits are checked first. Then every set is entered under its rarest
    shingles (``_entries``), where any two similar sets meet: first with ``HUBS`` of the documents there only, which joins most of
    a large group by a few links each, and then with all documents that are still in other components. Every link
    is checked by the sets themselves. Rows with a null id are left out, rows that repeat an id are one document, and texts
    without words are copies of each other.
    """
    if similarity < SIMILAR:
        raise ValueError(f"the search is made for similarities of at least {SIMILAR}")
    small_batches(docs.sparkSession)
    schema = arrow_schema("id long, content binary, fp long, signs binary")

    def prints(batch):
        import hashlib
        sets = [shingle_set(lower_words(t), shingle) for t in strings(batch.column(1))]
        columns = [[hashlib.md5(s.tobytes()).digest() for s in sets], [set_fingerprint(s) for s in sets], [signs(s) for s in sets]]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.binary()), pa.array(np.array(columns[1], np.uint64).view(np.int64)),
                                           pa.array(columns[2], pa.binary())], schema=schema)

    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    own = written(map_batches(rows, prints, "id long, content binary, fp long, signs binary"))
    copies = written(own.groupBy("content").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("fp").alias("fp"), F.any_value("signs").alias("signs")))
    member = written(own.select("id", "content").join(copies.select("content", "rep", "n"), "content").select("id", "rep", "n").distinct())
    # An id that repeats with other texts ties their representatives together.
    several = member.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("m")).where("b < m")
    tied = written(member.join(several, "id").where("rep > b").select(F.col("rep").alias("a"), "b"))
    marks = copies.select(F.col("rep").alias("id"), "signs")

    near = written(copies.groupBy("fp").agg(F.min("rep").alias("id")))
    close = near_links(near, radius).unionByName(copies.join(near, "fp").select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a <> b"))
    links = _checked(close, marks, rows, similarity, shingle).unionByName(tied)
    entries = written(_entries(rows, similarity, shingle))
    gone = written(member.where("id <> rep").select("id").distinct())
    alone = entries.join(F.broadcast(gone) if gone.count() <= IDS_SENT else gone, "id", "left_anti")     # texts and, as a rule, entries stay where they are
    met = written(_met_rows(alone.select("id", "n", F.explode("e").alias("e")).select("e.tok", "e.part", "id", "n", "e.at"), similarity))
    discard(near)
    discard(entries)
    links = written(links.unionByName(_checked(met.where("b IS NOT NULL").select(F.col("id").alias("a"), "b"), marks, rows, similarity, shingle)))
    joined = written(components(links))
    late = _checked(_apart(met.where("b IS NULL").drop("b"), joined, similarity), marks, rows, similarity, shingle)
    final = written(components(links.unionByName(late)))
    for table in (joined, met, links, tied, own, gone):
        discard(table)
    known = final.select(F.col("id").alias("rep"), "component")
    out = member.join(known, "rep", "left").where("component IS NOT NULL OR n > 1")
    return out.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))


def _checked(candidates: DataFrame, marks: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The candidates (a, b) whose shingle sets are similar. Signs leave few pairs whose sets must travel."""
    pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (marks.select(F.col("id").alias(c), F.col("signs").alias(f"s{c}")) for c in "ab")

    def alike(batch):
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SIGNS) for i in (2, 3))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(1) >= SIGNS_SHARED))

    left = written(map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), alike, "a long, b long"))
    out = written(_similar(left, rows, similarity, shingle))
    discard(left)
    return out


def _similar(candidates: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The candidates (a, b) with texts in ``rows`` (id, text) whose shingle sets are similar."""
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def shingles(batch):
        sets = [shingle_set(lower_words(t), shingle).tobytes() for t in strings(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    sets = map_batches(rows.join(wanted, "id"), shingles, "id long, s binary").distinct()
    left, right = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")

    def linked(batch):
        yes = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            yes.append(both >= similarity * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return map_batches(candidates.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), linked, "a long, b long")


def shingle_counts(rows: DataFrame, shingle: int, slots: int = SLOTS) -> np.ndarray:
    """How many documents of ``rows`` (id, text) hold a shingle, counted for ALL shingles in a table of fixed size.

    A shingle's first bits name its counter, which it shares with others, so a counter is never too small. Each task counts
    its rows; Spark adds up the blocks of the table.
    """
    import zlib
    shift, block = np.uint64(64 - slots.bit_length() + 1), min(SLOT_BLOCK, slots)
    ddl = "block int, counts binary"
    schema = arrow_schema(ddl)

    def packed(at: list[int], counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in counts], pa.binary())], schema=schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for text in strings(batch.column(0)):
                np.add.at(total, (shingle_set(lower_words(text), shingle) >> shift).astype(np.int64), 1)
        parts = total.reshape(-1, block)
        some = np.flatnonzero(parts.any(1))
        if len(some):
            yield packed(some.tolist(), parts[some])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}       # the blocks of one task: at most the table
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(zlib.decompress(counts), np.int64)
                total[at] = total[at] + now if at in total else now
        if total:
            yield packed(list(total), np.stack(list(total.values())))

    out = np.zeros((slots // block, block), np.int64)
    for r in rows.select("text").mapInArrow(counted, ddl).repartition("block").mapInArrow(added, ddl).collect():    # slots / block rows
        out[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


ENTRY = "tok long, part int, id long, n int, at int"
ENTRIES = "id long, n int, e array<struct<tok:long,part:int,at:int>>"


def _entries(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``rows`` (id, text) with their rarest shingles ``e``: any two similar sets have one of them in common.

    In any one order of all shingles two similar sets share one of their first ``n - similarity * n + 1`` (Chaudhuri, Ganti
    and Kaushik 2006). The order is by the counts of all documents and then by hash, so common passages come last. A
    shingle that stands out as more frequent than ``CHUNK`` documents is cut into parts, and pairs of parts meet.
    """
    counts = shingle_counts(rows, shingle)
    level = float(np.median(counts))                    # what other shingles add to a counter
    level += 8 * np.sqrt(level)
    table = rows.sparkSession.sparkContext.broadcast(counts)
    shift, chunk, schema = np.uint64(64 - SLOTS.bit_length() + 1), CHUNK, arrow_schema(ENTRIES)

    def entered(batch):
        out: list[list[np.ndarray]] = []
        ids, sizes = [], []
        for i, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            s = shingle_set(lower_words(text), shingle)
            if not len(s):
                continue
            often = table.value[(s >> shift).astype(np.int64)].astype(np.int64)
            first = np.lexsort((s, often))[:len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1]
            parts = 1 + np.maximum(often[first] - int(level), 0) // chunk
            part, at = np.zeros(len(first), np.int64), np.arange(len(first))
            if (parts > 1).any():
                mine = (i * 0x9E3779B1 & 0xFFFFFFFF) % parts
                at = np.repeat(at, parts)
                other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                own = mine[at]
                part = np.minimum(own, other) * parts[at] + np.maximum(own, other)
            out.append([s[first][at].view(np.int64), part.astype(np.int32), at.astype(np.int32)])
            ids.append(i)
            sizes.append(len(s))
        if not out:
            return None
        ends = np.concatenate([[0], np.cumsum([len(o[0]) for o in out])]).astype(np.int32)
        e = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], fields=list(schema.field(2).type.value_type))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), e)], schema=schema)

    return map_batches(rows, entered, ENTRIES)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of sorted batches as numbers, never with a bucket (first two columns) cut in two."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        now = now if held is None else np.concatenate([held, now])
        ends = np.flatnonzero((now[1:, :2] != now[:-1, :2]).any(1))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        held = now[cut:]
        if cut:
            yield now[:cut]
    if held is not None and len(held):
        yield held


def _met_rows(entries: DataFrame, similarity: float) -> DataFrame:
    """Entries of buckets with several documents, and candidates of them: the bucket's hubs as ``b``.

    Hubs are the smallest document and those that come first by some hashes of the id, the same ones in many buckets. Rows
    are entries (b is null) or candidates (id, b, nothing else). Most shingles belong to one document and end here.
    """
    ddl = f"{ENTRY}, b long"
    schema = arrow_schema(ddl)

    factors = np.random.default_rng(SEED + 2).integers(0, 1 << 62, HUBS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            begins = np.concatenate([[0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1])
            size = np.diff(np.append(begins, len(rows)))
            several = np.repeat(size, size) > 1
            if not several.any():
                continue
            rows, size = rows[several], size[size > 1]
            yield pa.RecordBatch.from_arrays([*[pa.array(rows[:, k]).cast(schema.field(k).type) for k in range(5)], pa.nulls(len(rows), pa.int64())], schema=schema)
            begins, bucket, found = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size), []
            for r in range(HUBS):
                order = np.arange(len(rows)) if not r else np.lexsort((rows[:, 2].view(np.uint64) * factors[r], bucket))
                hub = rows[np.repeat(order[begins], size)]
                fine = (rows[:, 2] != hub[:, 2]) & _possible(rows[:, 3], rows[:, 4], hub[:, 3], hub[:, 4], similarity)
                found.append(np.stack([rows[fine, 2], hub[fine, 2]], 1))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            if len(pairs):
                nothing = [pa.nulls(len(pairs), schema.field(k).type) for k in (0, 1, 3, 4)]
                yield pa.RecordBatch.from_arrays([*nothing[:2], pa.array(pairs[:, 0]), *nothing[2:], pa.array(pairs[:, 1])], schema=schema)

    return entries.repartition("tok", "part").sortWithinPartitions("tok", "part", "id").mapInArrow(run, ddl)


def _possible(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles can be similar that share the one at these places and only later ones (Xiao et al. 2008)."""
    most = np.minimum(n - at, m - to)
    return most * (1 + similarity) >= similarity * (n + m) - 1e-6


def _apart(entries: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of entries in one bucket whose documents are of different components and can be similar."""
    pairs = arrow_schema("a long, b long")
    known = joined.select("id", "component")
    dealt = entries.join(known, "id", "left").select("tok", "part", F.coalesce("component", "id").alias("component"), "id", "n", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            yield from _met(rows, similarity, pairs)

    return dealt.repartition("tok", "part").sortWithinPartitions("tok", "part", "component").mapInArrow(run, "a long, b long")


def _met(rows: np.ndarray, similarity: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs of whole buckets (columns as in ``_apart``, sorted by bucket and component) that pass the bounds of sizes and places."""
    if len(rows) < 2:
        return
    bucket = np.append(np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1, len(rows))
    same = np.append(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1, len(rows))
    every = np.arange(len(rows))
    upto, begin = bucket[np.searchsorted(bucket, every, "right")], same[np.searchsorted(same, every, "right")]
    meets = np.cumsum(upto - begin)
    at = 0
    while at < len(rows):
        till = max(at + 1, int(np.searchsorted(meets, (meets[at - 1] if at else 0) + 1_000_000, "right")))
        n = (upto - begin)[at:till]
        i = np.repeat(every[at:till], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begin[i]
        x, y = rows[i], rows[j]
        fine = _possible(x[:, 4], x[:, 5], y[:, 4], y[:, 5], similarity) & (x[:, 3] != y[:, 3])
        if fine.any():
            a, b = x[fine, 3], y[fine, 3]
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)
        at = till


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILAR, shingle: int = SHINGLE, radius: int = SEARCH_RADIUS,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the documents that are similar to one of a smaller id; rows that repeat a kept id all stay."""
    groups = written(similar_documents(docs, similarity, shingle, radius, id_column, text_column))
    gone = groups.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("_gone"))
    return docs.join(gone, docs[id_column].cast("long") == gone["_gone"], "left_anti")
