"""Spelling variants by permuterm rotations, with DataFrame functions throughout.

A word with a terminator, rotated so that the character before one place comes last, reads "what follows the character,
terminator, what precedes it, character". Words that differ in just this character share all of it but the last, and the
word without the character is that shared prefix itself, as a whole rotation of its own. So every rotation is dealt under
itself and under itself without its last character; each group of the sorted rotations then holds at most one word that is
the prefix and one word per character of the alphabet, however common a word is. A group gives each of its words the
number of its neighbours there and the best of them, never pairs. The word without one of a run of equal characters is
the neighbour only of the group that drops the run's first one, so no neighbour is counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LETTERS = "a-zÀ-ÿ"        # after A-Z became a-z
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
END = "$"                           # not a letter
LONG_KEY = 64                       # a longer rotation is dealt under its digest: a long word's rotations stay small


def dropped(key: Column, word: Column, divisor: int) -> Column:
    """The word without the code point that crc32 of ``key`` names, if ``divisor`` divides that number."""
    h = F.crc32(F.encode(key, "UTF-8"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % divisor == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(docs: DataFrame, divisor: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, of at least so many code points and occurrences.

    With a ``divisor``, a run loses a code point where ``dropped`` of "id:run" says so. A null text has no words; a null id
    counts as empty there.
    """
    low = F.translate(F.col(text_column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_id"), F.explode(F.split(low, f"[^{LETTERS}]+")).alias("word"))
    # A run loses code points only, so one that is too short now gives no word.
    runs = runs.where(F.length("word") >= least_length)
    if divisor:
        runs = runs.select(dropped(F.concat("_id", F.lit(":"), "word"), F.col("word"), divisor).alias("word")).where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): of each word (word, n) that has any, the number of words one edit away and the most frequent of them.

    Words are distinct. Ties of the best go to the smallest word in code-point order.
    """
    word, size = F.col("word"), F.length("word")

    def rotation(i: Column) -> Column:
        return F.concat(F.substring(word, i + 1, size), F.lit(END), F.substring(word, F.lit(1), i))

    def short(key: Column) -> Column:
        return F.when(F.length(key) > LONG_KEY, F.md5(F.encode(key, "UTF-8"))).otherwise(key)

    # ``last`` is the character that the key leaves out (none in the rotation itself); ``first`` says that it begins a run.
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        short(rotation(i)).alias("key"), F.lit(None).cast("string").alias("last"), F.lit(True).alias("first")))
    without = F.transform(F.filter(F.sequence(F.lit(0), size), lambda i: i > 0), lambda i: F.struct(
        short(F.concat(F.substring(word, i + 1, size), F.lit(END), F.substring(word, F.lit(1), i - 1))).alias("key"),
        F.substring(word, i, F.lit(1)).alias("last"),
        ((i == 1) | (F.substring(word, i, F.lit(1)) != F.substring(word, i - 1, F.lit(1)))).alias("first")))
    dealt = words.select(word, (-F.col("n")).alias("minus_n"), F.explode(F.concat(whole, without)).alias("r"))
    member = F.struct("minus_n", "word", F.col("r.last").alias("last"), F.col("r.first").alias("first"))
    # At most one member per character and one without: the array is bounded by the alphabet.
    groups = dealt.groupBy(F.col("r.key").alias("key")).agg(F.sort_array(F.collect_list(member)).alias("m")).where(F.size("m") > 1)
    changed = F.filter("m", lambda x: x["last"].isNotNull())
    prefix = F.get(F.filter("m", lambda x: x["last"].isNull()), F.lit(0))
    begins = F.filter("m", lambda x: x["last"].isNotNull() & x["first"])
    groups = groups.select("m", changed.alias("changed"), prefix.alias("prefix"), begins.alias("begins"))

    def best(x: Column) -> Column:
        return F.struct(x["minus_n"].alias("minus_n"), x["word"].alias("word"))

    def found(x: Column) -> Column:
        nothing = F.lit(None).cast("struct<minus_n:bigint,word:string>")
        other = F.when(F.get("changed", F.lit(0))["word"] == x["word"], F.get("changed", F.lit(1))).otherwise(F.get("changed", F.lit(0)))
        shorter = F.when(x["first"] & F.col("prefix").isNotNull(), best(F.col("prefix"))).otherwise(nothing)
        mine = F.least(F.when(other.isNotNull(), best(other)).otherwise(nothing), shorter)
        longer = F.get("begins", F.lit(0))
        is_prefix = x["last"].isNull()
        return F.struct(x["word"].alias("word"),
                        F.when(is_prefix, F.size("begins")).otherwise(F.size("changed") - 1 + shorter.isNotNull().cast("int")).cast("long").alias("k"),
                        F.when(is_prefix, F.when(longer.isNotNull(), best(longer)).otherwise(nothing)).otherwise(mine).alias("best"))

    told = groups.select(F.explode(F.transform("m", found)).alias("f")).select("f.*").where(F.col("k") > 0)
    out = told.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("b"))
    return out.select("word", "n_near", (-F.col("b.minus_n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last, twice as far each round.

    Forms never lead back (each is more frequent than its word), so the number of rounds is the logarithm of the longest way.
    """
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        fresh = written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if fresh.where("moved").limit(1).count() == 0:
            return fresh.select("word", "root")
        now = fresh.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Each word of ``words`` (word, n) with its form and root: word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one the other. The form is the near word of
    largest n (ties: the smallest) if that is at least ``factor`` (2 or more) times the word's n; form and form_n are null
    otherwise. The root is reached from the word by forms, itself if it has none. Words are distinct and hold no END, n is
    positive; other columns are not read. A null word is left out, as is a null n. No words give no rows.
    """
    if factor < 2:
        raise ValueError("a form must be at least twice as frequent")
    words = written(words.select("word", F.col("n").cast("long").alias("n")).where(F.col("word").isNotNull() & F.col("n").isNotNull()))
    near = words.join(neighbours(words), "word", "left")
    chosen = F.col("best_n") >= factor * F.col("n")
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best")).alias("form"),
                               F.when(chosen, F.col("best_n")).alias("form_n")))
    last = roots(near.where(F.col("form").isNotNull()))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
