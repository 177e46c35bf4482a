"""Line deduplication by winnowing over line hashes (Schleimer, Wilkerson and Aiken 2003), in DataFrame functions only.

Lines that are not blank are hashed without their outer blanks. The least hash of each window of ``window`` lines (the
rightmost of equals) is a fingerprint, so every run of at least ``window`` equal lines shares one. Fingerprints that occur
once in the corpus are dropped by an aggregate; the positions of the others are joined by the window around them, the
earliest position of each window is found by an aggregate, and matches are extended both ways by joining the windows that
overlap or touch. Where ``long_words`` is given, a line of more words is a run of its own: a window and a fingerprint beside
the others. Everything that meets on a key meets in a partial aggregate or a join, so a line that a third of all
documents share is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW, LONG_WORDS = 2, 50
BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _hashed(docs: DataFrame, id_column: str, text_column: str, long_words: int | None) -> DataFrame:
    """Key (_id, _text: a hash that tells rows of one id apart), the hashes of the lines that are not blank, and which of them are long."""
    lines = F.filter(F.transform(_lines(F.col(text_column)), _stripped), lambda x: x != "")
    hashes = F.transform(lines, lambda x: F.xxhash64(x)).alias("h")
    key = [F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_text")]
    if long_words is None:
        return docs.select(*key, hashes)
    # Words are counted only in lines that have room for so many.
    places = F.transform(lines, lambda x, i: F.when((F.length(x) > 2 * long_words) & (F.size(F.split(x, r"\s+")) > long_words), i))
    return docs.select(*key, hashes, F.filter(places, lambda i: i.isNotNull()).alias("long"))


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """Rows with the windows of their document: start, content and fingerprint of each."""
    def windows(starts: Column, size: int) -> Column:
        return F.transform(starts, lambda i: F.struct(
            i.alias("start"), F.slice("h", i + 1, size).alias("content"),
            F.array_min(F.transform(F.slice("h", i + 1, size), lambda x, j: F.struct(x.alias("h"), (-i - j).alias("back")))).alias("least")))

    every = windows(F.sequence(F.lit(0), F.greatest(F.size("h") - window, F.lit(0))), window)
    if "long" not in rows.columns or window == 1:
        return rows.where(F.size("h") >= window).withColumn("w", every)
    every = F.when(F.size("h") >= window, every).otherwise(F.slice(every, 1, 0))
    return rows.where((F.size("h") >= window) | (F.size("long") > 0)).withColumn("w", F.concat(every, windows(F.col("long"), 1)))


def repeated_runs(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", long_words: int | None = None) -> DataFrame:
    """One row per document with repeats: _id, _text and ``runs``, its maximal runs (from, upto) of lines that are not blank.

    A run is the union of windows of which an equal one begins earlier: in a smaller id (null first), or further up in the
    same document. With ``long_words`` a line of more words is a window too.
    """
    # Written, so that no text is split again for the filter and for each use of the hashes.
    seen = _windows(written(_hashed(docs, id_column, text_column, long_words)), window)
    prints = seen.select(F.explode(F.array_distinct(F.transform("w", lambda w: w["least"]))).alias("f")).select(F.col("f.h").alias("fp"))
    twice = written(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("fp"))
    spread = seen.select("_id", "_text", F.explode("w").alias("w")).select("_id", "_text", F.col("w.start").alias("start"),
                                                                         F.col("w.least.h").alias("fp"), F.col("w.content").alias("content"))
    met = written(spread.join(twice, "fp"))
    place = F.struct(F.col("_id").isNotNull().alias("given"), "_id", "_text", "start")
    first = met.groupBy("fp", "content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    later = met.join(first, ["fp", "content"]).where(place > F.col("first"))
    starts = later.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("start")).alias("s"))
    if long_words is not None:
        # Windows of two sizes: runs of their lines.
        spans = F.collect_set(F.struct("start", F.size("content").alias("n")))
        starts = later.groupBy("_id", "_text").agg(F.array_sort(F.array_distinct(F.flatten(F.transform(
            spans, lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))).alias("s"))
        window = 1
    begins = F.filter("s", lambda x, i: (i == 0) | (x - F.get("s", i - 1) > window))
    ends = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get("s", i + 1) - x > window))
    return starts.select("_id", "_text", F.arrays_zip(begins.alias("from"), F.transform(ends, lambda x: x + window).alias("upto")).alias("runs"))


def remove_repeated_runs(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", long_words: int | None = None) -> DataFrame:
    """All columns of ``docs`` with the text cleared of later repeated runs, and n_lines, n_removed, n_runs.

    Lines end at a newline; blank lines never match, and go only inside a removed run. Documents with fewer lines than the
    window keep all but lines of over ``long_words`` words that are repeats (None: no line goes alone). A null text stays null. Rows with equal id and text are one document and get one result; rows with an
    equal id and another text are ordered by a hash of the text. Ties in a fingerprint take the rightmost line. Columns of
    ``docs`` with the added names are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    runs = written(repeated_runs(docs, window, id_column, text_column, long_words)).toDF("_llm_id", "_llm_text", "_llm_runs")
    joined = docs.withColumn("_llm_key", F.xxhash64(text_column))
    # Texts and runs are both dealt by the document at every size; a broadcast would hold only while there are few repeats.
    joined = joined.join(runs.hint("merge"), joined[id_column].eqNullSafe(runs["_llm_id"]) & (F.col("_llm_key") == F.col("_llm_text")), "left").drop("_llm_id", "_llm_text", "_llm_key")
    changed = F.col("_llm_runs").isNotNull()
    row = joined.withColumn("_llm_lines", F.when(changed, _lines(F.col(text_column))))
    full = F.filter(F.transform("_llm_lines", lambda x, i: F.when(_stripped(x) != "", i)), lambda i: i.isNotNull())
    row = row.withColumn("_llm_full", full)
    # Runs in lines of the text: from the place of the first line up to that of the last one.
    row = row.withColumn("_llm_cut", F.transform("_llm_runs", lambda r: F.struct(F.get("_llm_full", r["from"]).alias("a"), (F.get("_llm_full", r["upto"] - 1) + 1).alias("b"))))
    parts = F.transform(F.sequence(F.lit(0), F.size("_llm_cut")), lambda i: F.slice(
        "_llm_lines", _end(i) + 1, F.coalesce(F.get("_llm_cut", i)["a"], F.size("_llm_lines")) - _end(i)))
    row = row.withColumn("_llm_kept", F.when(changed, F.flatten(parts)))
    breaks = F.octet_length(text_column) - F.octet_length(F.replace(F.col(text_column), F.lit("\n"), F.lit("")))
    result = F.struct(F.when(changed, F.array_join("_llm_kept", "\n")).otherwise(F.col(text_column)).alias(text_column),
                      F.coalesce(breaks + 1, F.lit(0)).alias("n_lines"), F.when(changed, F.size("_llm_lines") - F.size("_llm_kept")).otherwise(0).alias("n_removed"),
                      F.when(changed, F.size("_llm_cut")).otherwise(0).alias("n_runs"))
    # One row each: a filter on these columns stops here, instead of repeating the expressions above inside each other.
    out = row.select("*", F.explode(F.array(result)).alias("_llm_out"))
    return out.select(*[F.col("_llm_out")[c].alias(c) if c == text_column else F.col(c) for c in docs.columns], *[F.col("_llm_out")[c].alias(c) for c in ("n_lines", "n_removed", "n_runs")])


def _end(i: Column) -> Column:
    """Where the run before number i ended, 0 before the first one."""
    return F.when(i == 0, F.lit(0)).otherwise(F.get("_llm_cut", i - 1)["b"])


def repeated_lines_sql(window: int) -> str:
    """The same result by comparing all windows of lines."""
    blanks = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    window_of = " || chr(10) || ".join(f"lead(s, {i}) OVER w" if i else "s" for i in range(window))
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  f AS (SELECT doc_id, i, trim(line, {blanks}) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE trim(line, {blanks}) <> ''),
  c AS (SELECT doc_id, k, {window_of} AS content FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
  r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY content ORDER BY doc_id, k) AS n FROM c WHERE content IS NOT NULL) WHERE n > 1),
  g AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM (
        SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= {window} THEN 0 ELSE 1 END AS new FROM r)),
  m AS (SELECT doc_id, run, min(k) AS a, max(k) + {window} - 1 AS b FROM g GROUP BY doc_id, run),
  d AS (SELECT m.doc_id, min(f.i) AS a, max(f.i) AS b FROM m JOIN f ON f.doc_id = m.doc_id AND f.k BETWEEN m.a AND m.b GROUP BY m.doc_id, m.run),
  x AS (SELECT l.doc_id, l.i FROM l JOIN d ON l.doc_id = d.doc_id AND l.i BETWEEN d.a AND d.b),
  k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS kept, count(*) AS n FROM l ANTI JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id),
  n AS (SELECT doc_id, count(*) AS n_runs FROM d GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS INTEGER) AS n_lines,
  CAST(coalesce(len(string_split(text, chr(10))), 0) - coalesce(k.n, 0) AS INTEGER) AS n_removed, CAST(coalesce(n_runs, 0) AS INTEGER) AS n_runs, md5(coalesce(kept, '')) AS kept_md5
FROM documents t LEFT JOIN k ON k.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id"""
