"""A training corpus from ``documents``: judged, cleared of repeats, mixed and packed.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; between stages the documents are
written and read again, so a lost executor costs no more than a part of one stage.

All stages but the last return the columns they were given, whatever else is in them and however it is named; an empty table
gives an empty table. A null text counts as empty, and rows are told apart by their content and place, not by their ids,
except where a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspan.llm import lines, mixing, pack, quality, simhash
from panelspan.llm.common import discard, table, written
from panelspan.llm.queries import MIX, tokenizer_path


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _inner(docs: DataFrame) -> DataFrame:
    """The columns that the stages know, and any others out of the way in one."""
    rest = [c for c in docs.columns if c not in OWN]
    return docs.select(*OWN, *([F.struct(*[docs[c] for c in rest]).alias("_rest")] if rest else []))


def _outer(inner: DataFrame, docs: DataFrame) -> DataFrame:
    return inner.select(*[F.col(c) if c in OWN else F.col("_rest")[c].alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged like any other; without a source or language, what is known of all documents stands in
    for that level. Rows that repeat an id are judged one by one, all with the labels of that id. Without labels all stay.
    """
    return _outer(quality.judge(_inner(docs), table(spark, sf_dir, "labels")).where("keep"), docs)


def clear_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of two or more lines and of single lines of over 50 words go, and documents of which only blanks are left.

    n_chars follows the text. Later means a larger id, then a later place; null ids come first. A document that nothing was
    removed from stays as it is, also a null or empty one.
    """
    cleared = lines.remove_repeated_runs(_inner(docs), long_words=lines.LONG_WORDS).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return _outer(cleared.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))), docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are 0.8 similar, the one with the smallest id stays.

    Texts without words are copies of each other. Rows with a null id all stay, and so do rows that repeat the id that stays.
    """
    return simhash.keep_one_of_each(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as its rate says, and at least once.

    A document without text has no tokens and comes once. Repeated ids are documents of their own.
    """
    mixed = mixing.mix(_inner(docs), table(spark, sf_dir, "labels"), MIX, least=1.0)
    return _outer(mixed.where("copies > 0").withColumn("_use", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all uses of all documents with their token ids, in windows of 2048.

    A null or empty text is its end alone. Ties of length keep the order of rows; repeated and null ids are documents of
    their own. An empty table gives no pieces.
    """
    return pack.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good), ("line dedup", clear_lines), ("SimHash near-dedup", keep_one),
    ("mixing to target weights", mix_languages), ("packing", pack_windows)]

ORACLE_SQL = None       # classifiers and packing are not SQL; tests/llm hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
