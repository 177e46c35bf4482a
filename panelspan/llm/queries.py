"""The thin queries over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pack as packing
from . import hmm, lines, mixing, neighbours, quality, simhash, squares, suffixes, toxicity, variants, vectors, whitening
from .common import crc32_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op6_pack_sequences")
def op6(spark, sf_dir):
    """Windows of 2048 tokens; the digest of a piece's ids is taken from the ids that the operator returns."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_toxicity")
def op3(spark, sf_dir):
    """Score of every text; labels of documents whose crc32(doc_id) mod 4 is 2 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    sample = toxicity.labelled_sample(labels, "toxic", ~held_out, toxicity.FIT_ROWS)
    scores = toxicity.score(docs, *toxicity.fit(docs, sample))
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op4_quality")
def op4(spark, sf_dir):
    """Every document judged by its text, its source (host) and the language part of it (path)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality.judge(docs.select("doc_id", "text", "lang", "source"), labels)
    return judged.select("doc_id", *[F.round(c, 9).alias(c) for c in ("p_doc", "host_rate", "path_rate", "p_good")], "keep")


@query("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    """Components of fingerprints of four-word shingles that differ in at most four bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_vectors_sql(threshold: float) -> str:
    """Brute force over pairs of equal labels, with components as the smallest id that a recursive walk reaches."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {threshold}),
  walk AS (SELECT vec_id AS id, vec_id AS seen FROM v UNION SELECT w.id, l.b FROM walk w JOIN link l ON l.a = w.seen),
  comp AS (SELECT id, min(seen) AS component_id FROM walk GROUP BY id), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON id = vec_id LEFT JOIN n ON a = vec_id"""


@query("op2_embedding_near_dedup", near_vectors_sql(0.93))
def op2(spark, sf_dir):
    """Links of vectors of one label with a cosine of at least 0.93."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op7_nearest_neighbours")
def op7(spark, sf_dir):
    """Five nearest of every vector whose id is divisible by 50, among all others."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op8_line_dedup", lines.repeated_lines_sql(2))
def op8(spark, sf_dir):
    """Later repeats of two or more lines go; the digest is of the text that stays."""
    kept = lines.remove_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), window=2)
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


MIX = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


@query("op10_mixing")
def op10(spark, sf_dir):
    """Rates of all documents for fixed shares of four languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), MIX)
    shares = [F.round(F.get("posterior", F.lit(i)), 9).alias(f"p_{d}") for i, d in enumerate(MIX)]
    return mixed.select("doc_id", "n_tokens", *shares, F.round("rate", 9).alias("rate"), "copies", "settled")


@query("op1_hmm_scores")
def op1(spark, sf_dir):
    """Scores of all documents by a model of those whose crc32(doc_id) mod 7 is not 2."""
    return hmm.score(table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 7) == 2)


@query("op9_suffix_dedup")
def op9(spark, sf_dir):
    """Bytes of 50-byte strings of documents with smaller ids go; the digest is of the bytes that the operator keeps."""
    cleared = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["upto"] - s["from"])
    return cleared.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_square_packing")
def op11(spark, sf_dir):
    """Sequences of at most 1024 tokens; the digest of a piece's ids is the operator's."""
    pieces = squares.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=2)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


VARIANTS_SQL = """WITH RECURSIVE table_steps AS (SELECT range AS b, range AS v, 0 AS k FROM range(256)
    UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM table_steps WHERE k < 8),
  crc_table AS (SELECT b, v FROM table_steps WHERE k = 8),
  runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
  uses AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS m FROM runs WHERE length(run) >= 5 GROUP BY ALL),
  coded AS (SELECT s, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS bytes FROM uses),
  steps AS (SELECT s, bytes, 0 AS i, 4294967295 AS acc FROM coded
    UNION ALL SELECT s, bytes, i + 1, xor(acc // 256, v) FROM steps JOIN crc_table ON b = xor(acc, CAST(bytes[i + 1] AS BIGINT)) % 256 WHERE i < len(bytes)),
  hashed AS (SELECT s, xor(acc, 4294967295) AS h FROM steps WHERE i = len(bytes)),
  spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, m FROM uses JOIN hashed USING (s)),
  words AS (SELECT w, CAST(sum(m) AS BIGINT) AS n FROM spelt WHERE length(w) >= 5 GROUP BY w HAVING sum(m) >= 3),
  places AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words),
  masked AS (SELECT w, n, i, substr(w, 1, i - 1) || '*' || substr(w, i + 1) AS p, substr(w, 1, i - 1) || substr(w, i + 1) AS cut FROM places),
  near AS (SELECT a.w, b.w AS u, b.n AS un FROM masked a JOIN masked b ON a.p = b.p AND a.w <> b.w
    UNION SELECT a.w, b.w, b.n FROM masked a JOIN words b ON a.cut = b.w
    UNION SELECT b.w, a.w, a.n FROM masked a JOIN words b ON a.cut = b.w),
  best AS (SELECT w, count(*) AS n_near, first(u ORDER BY un DESC, u) AS u, max(un) AS un FROM near GROUP BY w),
  forms AS (SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN un >= 2 * n THEN u END AS form, CASE WHEN un >= 2 * n THEN un END AS form_n FROM words LEFT JOIN best USING (w)),
  walk AS (SELECT w, w AS at FROM forms UNION ALL SELECT walk.w, forms.form FROM walk JOIN forms ON forms.w = walk.at WHERE forms.form IS NOT NULL),
  ends AS (SELECT walk.w, walk.at AS root FROM walk JOIN forms ON forms.w = walk.at WHERE forms.form IS NULL)
SELECT w AS word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN ends USING (w)"""


@query("op12_spelling_variants", VARIANTS_SQL)
def op12(spark, sf_dir):
    """Words of all documents, one in 97 of their uses short of a letter, and the frequent words that they vary."""
    return variants.spelling_variants(variants.word_counts(table(spark, sf_dir, "documents"), divisor=97))


@query("op13_whitening")
def op13(spark, sf_dir):
    """All embeddings on the four components of largest deviation."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
