"""Plan helpers shared by every operator.

* ``materialise`` cuts lineage by writing a table to the shared checkpoint folder. The table is
  read back with its real file size, so Spark broadcasts it in later joins only when that size is
  below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
* ``attach`` puts per-group statistics next to the rows of the group.
* ``Series`` gives ordered operations (lag, position, running sum). A series that is too long for
  one sort task is cut into ranges of its order key, and values are carried over the cuts.
* ``exact_quantile`` finds exact order statistics without sorting a group in one task.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES_ROWS = 1_000_000     # longest series that one window task sorts
MEDIAN_ROWS = 200_000       # largest group handed to the built-in exact median
QUANTILE_BINS = 1024
QUANTILE_PICK = 2_000       # rows of the final bin that are sorted in an array
SALTS = 16                  # keys that a group's rows are dealt over where its statistics are not broadcast


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one that ``spark.checkpoint.dir`` names; in local mode without it, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="panelspan-"))
    return _LOCAL[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table, which goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/panelspan/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:       # the session is over: the cluster's own cleaning takes the folder
        return


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of ``stats`` (one row per ``by`` group) to every row of ``df``.

    With groups this is a join; ``stats`` should be a written table, so that Spark knows its size. Statistics too large to be
    broadcast are repeated ``SALTS`` times and every group's rows dealt over as many keys, so a hot group is not one task.
    Without groups the single row of numbers is computed once and inlined. A lazy scalar subquery is
    planned once per column used, which could read the facts behind ``stats`` several times.
    """
    if by:
        if _plan_bytes(stats) <= _broadcast_bytes(df.sparkSession):
            return df.join(stats, list(by), "inner")
        hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
        salt = F.pmod(F.xxhash64(*hashed) + F.spark_partition_id(), F.lit(SALTS))
        many = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return df.withColumn("_salt", salt).join(many, [*by, "_salt"], "inner").drop("_salt")
    types = {f.name: f.dataType for f in stats.schema.fields}
    if any(isinstance(t, (T.StructType, T.ArrayType, T.MapType)) for t in types.values()):
        stats = materialise(stats)
        one_row = stats.select(F.struct(*stats.columns)).scalar()
        return df.select("*", *[one_row.getField(c).alias(c) for c in stats.columns])
    row = stats.first()
    return df.select("*", *[F.lit(row[c] if row else None).cast(t).alias(c) for c, t in types.items()])


def _plan_bytes(df: DataFrame) -> int:
    """Spark's own size of a plan: of the files for a written table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _broadcast_bytes(spark: SparkSession) -> int:
    """Size up to which Spark broadcasts by itself."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit) if not limit.lstrip().startswith("-") else -1


def group_agg(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def longest_group(df: DataFrame, by: Sequence[str]) -> int:
    sizes = group_agg(df, by, F.count(F.lit(1)).alias("n"))
    return int(sizes.agg(F.max("n")).first()[0] or 0)


# ---------------------------------------------------------------------------------------------
# Ordered series
# ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Series:
    """Rows of one or many series with an explicit order.

    ``part`` numbers the range of the order key a row falls in. It is constant while every series
    fits one task, and then all operations are plain windows.
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    part = "_part"

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], order: Sequence[str] | str,
           max_rows: int | None = None) -> Series:
        order = (order,) if isinstance(order, str) else tuple(order)
        keys = tuple(keys)
        limit = SERIES_ROWS if max_rows is None else max_rows
        if longest_group(df, keys) <= limit:
            return cls(df.withColumn(cls.part, F.lit(0)), keys, order, False)
        parts = max(2, math.ceil(df.count() / limit))
        ranged = (df.repartitionByRange(parts, *keys, *order)
                  .withColumn(cls.part, F.spark_partition_id()))
        # The range bounds come from a sample: write the rows so that every later read agrees.
        return cls(materialise(ranged), keys, order, True)

    def _window(self):
        return Window.partitionBy(*self.keys, self.part).orderBy(*self.order)

    def _with(self, df: DataFrame) -> Series:
        return Series(df, self.keys, self.order, self.split)

    def _part_window(self):
        return Window.partitionBy(*self.keys).orderBy(self.part)

    def _join_parts(self, df: DataFrame, parts: DataFrame) -> DataFrame:
        return df.join(parts, [*self.keys, self.part], "left")

    def number(self, name: str = "_i") -> Series:
        """Position of the row in its series, from 1."""
        inside = self.df.withColumn(name, F.row_number().over(self._window()).cast("long"))
        if not self.split:
            return self._with(inside)
        before = Window.partitionBy(*self.keys).orderBy(self.part).rowsBetween(
            Window.unboundedPreceding, -1)
        parts = (self.df.groupBy(*self.keys, self.part).agg(F.count(F.lit(1)).alias("_n"))
                 .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
        out = self._join_parts(inside, parts).withColumn(name, F.col(name) + F.col("_off"))
        return self._with(out.drop("_off"))

    def running_sum(self, **sums: Column) -> Series:
        """Inclusive running sums ``name=expression`` in series order."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        inside = self.df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
        if not self.split:
            return self._with(inside)
        before = Window.partitionBy(*self.keys).orderBy(self.part).rowsBetween(
            Window.unboundedPreceding, -1)
        parts = self.df.groupBy(*self.keys, self.part).agg(
            *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
        parts = parts.select(*self.keys, self.part, *[
            F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_c_{n}") for n in sums])
        out = self._join_parts(inside, parts)
        for n in sums:
            out = out.withColumn(n, F.col(n) + F.col(f"_c_{n}"))
        return self._with(out.drop(*[f"_c_{n}" for n in sums]))

    def lag(self, **lags: tuple[str, int]) -> Series:
        """Add ``name=(column, k)``: the value of ``column`` k rows earlier in the series."""
        w = self._window()
        inside = self.df.select("*", *[F.lag(c, k).over(w).alias(n) for n, (c, k) in lags.items()])
        if not self.split:
            return self._with(inside)
        depth = max(k for _, k in lags.values())
        cols = sorted({c for c, _ in lags.values()})
        last = Window.partitionBy(*self.keys, self.part).orderBy(
            *[F.col(o).desc() for o in self.order])
        tails = (self.df.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= depth)
                 .groupBy(*self.keys, self.part)
                 .agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), *cols)))
                      .alias("_tail")))
        earlier = self._part_window().rowsBetween(-depth, -1)
        carry = tails.select(*self.keys, self.part,
                             F.flatten(F.collect_list("_tail").over(earlier)).alias("_carry"))
        out = self._join_parts(inside.withColumn("_at", F.row_number().over(w)), carry)
        for n, (c, k) in lags.items():
            place = F.size("_carry") + F.col("_at") - F.lit(k)
            carried = F.when((F.col("_at") <= k) & (place >= 1),
                             F.try_element_at("_carry", place.cast("int")).getField(c))
            out = out.withColumn(n, F.when(F.col("_at") > k, F.col(n)).otherwise(carried))
        return self._with(out.drop("_at", "_carry"))

    def rows(self) -> DataFrame:
        return self.df.drop(self.part)


# ---------------------------------------------------------------------------------------------
# Exact order statistics
# ---------------------------------------------------------------------------------------------

def exact_quantile(df: DataFrame, col: str, q: float = 0.5, by: Sequence[str] = (),
                   alias: str = "quantile", max_rows: int | None = None) -> DataFrame:
    """Exact quantile (linear interpolation) of ``col``, one row per group.

    Small groups use the built-in aggregate. Larger ones are narrowed by counting passes: each
    pass counts ``QUANTILE_BINS`` bins per group and keeps the bin that holds the wanted rank, until
    that bin has one value or few enough rows to sort in an array.
    """
    by = list(by)
    src = df.select(*by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    limit = MEDIAN_ROWS if max_rows is None else max_rows
    size = materialise(group_agg(src, by, F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"),
                                 F.max("_v").alias("_hi")))
    if int(size.agg(F.max("_n")).first()[0] or 0) <= limit:
        return group_agg(src, by, F.percentile("_v", F.lit(q)).alias(alias))
    place = (F.col("_n") - 1) * F.lit(float(q))
    goals = size.select(
        *by, "_lo", "_hi", (place - F.floor(place)).alias("_w"),
        F.explode(F.array(F.struct(F.lit(0).alias("t"), F.floor(place).alias("r")),
                          F.struct(F.lit(1).alias("t"), F.ceil(place).alias("r")))).alias("_g"))
    state = materialise(goals.select(
        *by, "_lo", "_hi", "_w", F.col("_g.t").alias("_t"),
        F.col("_g.r").cast("long").alias("_rank"), F.lit(0).cast("long").alias("_before"),
        F.col("_lo").alias("_value"), (F.col("_lo") == F.col("_hi")).alias("_done")))

    while state.where(~F.col("_done")).limit(1).count():
        state = materialise(_narrow(src, state, by))
    out = state.groupBy(*by).agg(
        F.max(F.when(F.col("_t") == 0, F.col("_value"))).alias("_v0"),
        F.max(F.when(F.col("_t") == 1, F.col("_value"))).alias("_v1"), F.max("_w").alias("_w"))
    return out.select(*by, (F.col("_v0") + F.col("_w") * (F.col("_v1") - F.col("_v0"))).alias(alias))


def _narrow(src: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """One counting pass: the bin of each open goal replaces its range."""
    open_goals = state.where(~F.col("_done"))
    if by:
        hits = src.join(open_goals, by)
    else:       # at most two goals: keep them as one array value, not as a join
        goals = open_goals.agg(F.collect_list(F.struct(*open_goals.columns))).scalar()
        hits = src.select("_v", F.explode(goals).alias("_o")).select("_v", "_o.*")
    hits = hits.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    # Halves, so that the width of a range of very large numbers stays finite.
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    bin_of = F.least(F.lit(QUANTILE_BINS - 1), F.floor(share * QUANTILE_BINS)).cast("int")
    keys = [*by, "_t"]
    bins = (hits.withColumn("_bin", bin_of).groupBy(*keys, "_bin")
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"),
                 *[F.first(c).alias(c) for c in ("_rank", "_before", "_w")]))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    chosen = (bins.withColumn("_cum", F.col("_before") + F.sum("_n").over(upto))
              .where((F.col("_rank") < F.col("_cum")) & (F.col("_rank") >= F.col("_cum") - F.col("_n")))
              .select(*keys, "_rank", "_w", (F.col("_cum") - F.col("_n")).alias("_before"), "_n",
                      F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi")))
    chosen = materialise(chosen)

    small = chosen.where((F.col("_n") <= QUANTILE_PICK) & (F.col("_lo") < F.col("_hi")))
    if by:
        inside = src.join(small.select(*by, "_t", "_lo", "_hi"), by)
    else:
        goals = small.agg(F.collect_list(F.struct("_t", "_lo", "_hi"))).scalar()
        inside = src.select("_v", F.explode(goals).alias("_o")).select("_v", "_o.*")
    picked = (inside.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
              .groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_sorted")))
    joined = chosen.join(picked, keys, "left")
    nth = F.try_element_at("_sorted", (F.col("_rank") - F.col("_before") + 1).cast("int"))
    done = (F.col("_lo") == F.col("_hi")) | F.col("_sorted").isNotNull()
    fresh = joined.select(*by, "_lo", "_hi", "_w", "_t", "_rank", "_before",
                          F.coalesce(nth, F.col("_lo")).alias("_value"), done.alias("_done"))
    return state.where(F.col("_done")).unionByName(fresh)
