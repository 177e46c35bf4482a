"""Cleaning, reshaping, joining, lagging and model admissibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DATELIKE, as_double, clean_numeric, dtype_of, finite, is_numeric
from ..plans.scale import Series, group_agg
from ..spec import PanelSpec, all_models, candidates

YEAR_MIN, YEAR_MAX = 1800, 2100
UNIT_NAMES = ("country", "COUNTRY", "Country", "country_name", "LOCATION", "Country_Name")
# Words left out when names of units are compared.
NAME_PREFIXES = ("people's republic of", "republic of", "kingdom of",
                 "special administrative region", "the ", "province of", "commonwealth of", "state of ")


def filter_unit(df: DataFrame, unit: str, value) -> DataFrame:
    """Rows of one unit (the filter reaches the scan)."""
    return df.where(F.col(unit) == F.lit(value))


def filter_positive(df: DataFrame, outcome: str, treatment: str | None = None) -> DataFrame:
    """Rows whose coerced outcome (and predictor, if given) is above zero."""
    out = df.where(as_double(df, outcome) > 0)
    return out if treatment is None else out.where(as_double(df, treatment) > 0)


# --- reshape and join --------------------------------------------------------------------------

def year_columns(columns: Sequence[str]) -> list[str]:
    """Column names that are whole numbers from 1800 to 2100."""
    return [c for c in columns if c.strip().isdigit() and YEAR_MIN <= int(c) <= YEAR_MAX]


def indicator_tier(name: str) -> int | None:
    """Rank of a column name as holder of indicator names (1 is best)."""
    low = name.lower()
    has = low.__contains__
    rules = (low in ("indicator", "series_name", "seriesname"), has("indicator") and not has("code"),
             has("series") and has("name"), has("name") and not has("code"), has("series"))
    return next((i for i, hit in enumerate(rules, 1) if hit), None)


def find_indicator_column(df: DataFrame) -> DataFrame:
    """The column holding indicator names: best name tier, then most distinct values."""
    tiers = {c: indicator_tier(c) for c in df.columns}
    best = min((t for t in tiers.values() if t), default=None)
    names = [c for c, t in tiers.items() if t == best and best]
    if not names:
        return df.select(F.lit(None).cast("string").alias("indicator_column"),
                         F.lit(None).cast("long").alias("n_unique")).limit(0)
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in names])
    rows = counts.select(F.explode(F.array(*[
        F.struct(F.col(c).alias("n_unique"), F.lit(-df.columns.index(c)).alias("place"),
                 F.lit(c).alias("indicator_column")) for c in names])).alias("r"))
    return rows.agg(F.max("r").alias("r")).select("r.indicator_column", "r.n_unique")


def unpivot_years(df: DataFrame, unit: str | None = None, indicator: str | None = None,
                  years: Sequence[str] | None = None) -> DataFrame:
    """Wide indicator table -> (unit, indicator, year, value)."""
    years = list(years or year_columns(df.columns))
    if not years:
        raise ValueError("No year-like columns found to pivot")
    if indicator is None:
        first = find_indicator_column(df).first()
        if first is None:
            raise ValueError("No indicator column found to pivot")
        indicator = first["indicator_column"]
    if unit is None:
        unit = next((c for c in UNIT_NAMES if c in df.columns), None) or next(
            c for c in df.columns if c not in years and c != indicator)
    wide = df.select(unit, indicator, *[as_double(df, y).alias(y) for y in years])
    return (wide.unpivot([unit, indicator], years, "year", "value")
            .withColumn("year", F.col("year").cast("int")))


def indicator_filter(long: DataFrame, indicator: str, name: str) -> DataFrame:
    """Rows whose indicator contains ``name`` as literal text, any case."""
    return long.where(F.contains(F.lower(F.col(indicator).cast("string")), F.lit(name.lower())))


def indicator_join(long: DataFrame, unit: str, indicator: str, outcome: str, treatment: str,
                   time: str = "year", value: str = "value", agg: str | None = None) -> DataFrame:
    """Outcome and treatment series side by side, one row per (unit, time).

    The two indicators are picked in one conditional aggregate, so the long table is read and
    shuffled once. Several indicators matching one name are an error unless ``agg`` says how to
    combine them (``mean``, ``min`` or ``max``).
    """
    text = F.lower(F.col(indicator).cast("string"))
    is_y, is_x = F.contains(text, F.lit(outcome.lower())), F.contains(text, F.lit(treatment.lower()))
    if agg is None:
        names = (long.where(is_y | is_x).groupBy(indicator).agg(F.any_value(is_y).alias("y"),
                                                                F.any_value(is_x).alias("x"))
                 .agg(F.count_if("y").alias("y"), F.count_if("x").alias("x")).first())
        for label, wanted in (("y", outcome), ("x", treatment)):
            if names[label] > 1:
                raise ValueError(f"{names[label]} indicators match '{wanted}'; name one or give agg=")
    how = {None: F.avg, "mean": F.avg, "min": F.min, "max": F.max}[agg]
    pair = (long.where(is_y | is_x).groupBy(unit, time)
            .agg(how(F.when(is_y, F.col(value))).alias(outcome), how(F.when(is_x, F.col(value))).alias(treatment),
                 F.count_if(is_y).alias("_ny"), F.count_if(is_x).alias("_nx")))
    return pair.where((F.col("_ny") > 0) & (F.col("_nx") > 0)).drop("_ny", "_nx")


# --- order-dependent columns ---------------------------------------------------------------------

def lag_predictor(df: DataFrame, treatment: str, time: str, unit: str | None = None, k: int = 1,
                  max_series_rows: int | None = None) -> DataFrame:
    """Add ``<treatment>_lag<k>``: the value k rows earlier in the unit, in time order."""
    s = Series.of(df, [unit] if unit else [], time, max_series_rows)
    return s.lag(**{f"{treatment}_lag{k}": (treatment, k)}).rows()


def series_by_time(df: DataFrame, outcome: str, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean outcome per period: ``by..., time, y, n``."""
    f = clean_numeric(df, {"y": outcome, "time": time}, by)
    return f.groupBy(*by, "time").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


# --- facts about roles ---------------------------------------------------------------------------

def panel_check(df: DataFrame, unit: str | None, time: str | None) -> bool:
    return bool(unit and time and unit in df.columns and time in df.columns)


def treatment_varies(df: DataFrame, treatment: str, unit: str, by: Sequence[str] = ()) -> DataFrame:
    """Whether any unit has more than one treatment value, and how many do."""
    per_unit = (df.where(F.col(unit).isNotNull()).groupBy(*by, unit)
                .agg((F.min(treatment) < F.max(treatment)).alias("v")))
    return group_agg(per_unit, by, F.coalesce(F.bool_or("v"), F.lit(False)).alias("varies"),
                     F.count_if("v").alias("units_varying"), F.count(F.lit(1)).alias("n_units"))


def positivity_check(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per column: all coerced values above zero and at least one value."""
    f = df.select(*by, *[as_double(df, c).alias(c) for c in columns])
    aggs = [F.struct(F.lit(c).alias("column"), F.count_if(finite(c)).alias("n"),
                     F.min(F.when(finite(c), F.col(c))).alias("smallest")) for c in columns]
    rows = group_agg(f, by, F.array(*aggs).alias("a")).select(*by, F.explode("a").alias("a"))
    return rows.select(*by, "a.column", "a.n", "a.smallest",
                       F.coalesce((F.col("a.n") > 0) & (F.col("a.smallest") > 0), F.lit(False)).alias("positive"))


def pick_time_column(df: DataFrame, wanted: str | None = None) -> str | None:
    """Named time column, else the first datetime column, else the first numeric one that looks like years."""
    if wanted and wanted in df.columns:
        return wanted
    for c in df.columns:
        if isinstance(dtype_of(df, c), DATELIKE):
            return c
    numbers = [c for c in df.columns if is_numeric(df, c)]
    if not numbers:
        return None
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in numbers]).first()
    return next((c for c in numbers if row[c]["m"] is not None and row[c]["s"] is not None
                 and YEAR_MIN <= row[c]["m"] <= YEAR_MAX and row[c]["s"] < 50), None)


def numeric_outcome_fallback(df: DataFrame, outcome: str) -> str:
    """The outcome itself if numeric, else the first numeric column with more than five values."""
    if outcome in df.columns and is_numeric(df, outcome):
        return outcome
    numbers = [c for c in df.columns if is_numeric(df, c) and c != outcome]
    if not numbers:
        return outcome
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in numbers]).first()
    return next((c for c in numbers if row[c] > 5), outcome)


def sample_pairs(df: DataFrame, outcome: str, treatment: str, key: Sequence[str], limit: int = 600,
                 seed: int = 42, unit: str | None = None) -> DataFrame:
    """At most ``limit`` complete (x, y) pairs: those with the smallest hash of their key.

    A top-k on the hash keeps ``limit`` rows per task, and gives the same rows on every run.
    """
    keep = [*key, *([unit] if unit and unit not in key else [])]
    f = clean_numeric(df, {"y": outcome, "x": treatment}, keep=keep)
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return f.orderBy(place, *key).limit(limit)


def resolve_unit(units: DataFrame, unit: str, requests: DataFrame, text: str) -> DataFrame:
    """Best stored unit for each free-text request (``text`` column).

    Exact match first, then equality without honorific prefixes, then containment either way
    (shortest name first). Containment is an equi-join on substrings of the lengths that occur,
    not a comparison of all pairs.
    """
    def cleaned(c: Column) -> Column:
        out = F.lower(c.cast("string"))
        for p in NAME_PREFIXES:
            out = F.replace(out, F.lit(p), F.lit(""))
        return F.trim(out, F.lit(" ,"))

    stored = (units.select(F.col(unit).alias("unit")).where(F.col("unit").isNotNull()).distinct()
              .withColumn("_u", cleaned(F.col("unit"))).where(F.length("_u") > 0))
    asked = (requests.select(F.col(text).alias("request")).where(F.col("request").isNotNull()).distinct()
             .withColumn("_q", cleaned(F.col("request"))))

    exact = stored.join(asked, stored["unit"] == asked["request"]).select(
        "request", "unit", F.lit(3.0).alias("score"))
    same = stored.join(asked, stored["_u"] == asked["_q"]).select("request", "unit", F.lit(2.0).alias("score"))
    lengths_u = stored.agg(F.collect_set(F.length("_u")).alias("k")).scalar()
    lengths_q = asked.agg(F.collect_set(F.length("_q")).alias("k")).scalar()
    inner = _substring_join(stored, "_u", asked.where(F.length("_q") > 3), "_q", lengths_q)
    outer = _substring_join(asked.where(F.length("_q") > 3), "_q", stored, "_u", lengths_u)
    score = 1 / (1 + 0.1 * F.size(F.split("unit", r"\s+")))
    part = inner.unionByName(outer).select("request", "unit", score.alias("score"))
    best = exact.unionByName(same).unionByName(part)
    return best.groupBy("request").agg(
        F.max(F.struct("score", (-F.length("unit")).alias("l"), "unit")).alias("b")).select(
        "request", F.col("b.unit").alias("unit"), F.col("b.score").alias("score"))


def _substring_join(hay: DataFrame, h: str, needle: DataFrame, n: str, lengths: Column) -> DataFrame:
    """Pairs where ``n`` occurs in ``h``: substrings of the lengths that needles have, then equality."""
    sized = hay.select("*", F.explode(lengths).alias("_k")).where(F.col("_k") <= F.length(h))
    cuts = F.transform(F.sequence(F.lit(1), F.length(h) - F.col("_k") + 1),
                       lambda i: F.substring(F.col(h), i, F.col("_k")))
    pieces = sized.select("*", F.explode(F.array_distinct(cuts)).alias("_piece"))
    return pieces.join(needle, pieces["_piece"] == needle[n]).select("request", "unit")


# --- admissibility -------------------------------------------------------------------------------

def admissible_models(df: DataFrame, spec: PanelSpec, by: Sequence[str] = ()) -> DataFrame:
    """Every candidate of the question type with rank, status and reason.

    All data facts (within-unit variation, smallest outcome and predictor) come from one aggregate
    over (group, unit); the rules are then expressions on one row per group.
    """
    by = list(by)
    names = {"outcome": spec.outcome, "treatment": spec.treatment, "unit": spec.unit, "time": spec.time}
    have = {k: v for k, v in names.items() if v and v in df.columns}
    cols = [*by, *([F.col(have["unit"]).alias("_unit")] if "unit" in have else [F.lit(0).alias("_unit")])]
    for k, a in (("outcome", "_y"), ("treatment", "_x")):
        cols.append((as_double(df, have[k]) if k in have else F.lit(None).cast("double")).alias(a))
    raw = F.col(have["treatment"]) if "treatment" in have else F.lit(None).cast("double")
    rows = df.select(*cols, raw.alias("_raw"))
    per_unit = rows.groupBy(*by, "_unit").agg(
        F.min(F.when(finite("_y"), F.col("_y"))).alias("_ly"), F.min(F.when(finite("_x"), F.col("_x"))).alias("_lx"),
        (F.min("_raw") < F.max("_raw")).alias("_v"), F.count(F.lit(1)).alias("_n"))
    facts = group_agg(per_unit, by, F.min("_ly").alias("_ly"), F.min("_lx").alias("_lx"),
                      F.coalesce(F.bool_or(F.col("_v") & F.col("_unit").isNotNull()), F.lit(False)).alias("_varies"),
                      F.sum("_n").alias("_n"))
    rules = []
    for rank, name in enumerate(candidates(spec.question_type), 1):
        rules.append(F.struct(F.lit(name).alias("model"), F.lit(rank).alias("rank"),
                              _reason(name, names, have).alias("reason")))
    out = facts.select(*by, F.explode(F.array(*rules)).alias("r"))
    status = F.when(F.col("r.reason").isNull(), "valid").otherwise("rejected")
    return out.select(*by, "r.model", "r.rank", status.alias("status"), "r.reason")


def _reason(model: str, names: dict, have: dict) -> Column:
    m = all_models()[model]
    missing = [k for k in m.required if names[k] is None]
    absent = [f"{k}={names[k]}" for k in m.required if names[k] is not None and k not in have]
    if missing:
        return F.lit("Missing required fields: " + ", ".join(missing))
    if absent:
        return F.lit("Columns not in data: " + ", ".join(absent))
    reason = F.lit(None).cast("string")
    if m.needs_variation:
        reason = F.when(~F.col("_varies"), F.lit(f"Predictor '{names['treatment']}' does not vary within units"))
    if m.positive_outcome:
        reason = F.coalesce(reason, F.when(~F.coalesce(F.col("_ly") > 0, F.lit(False)),
                                           F.lit(f"Outcome '{names['outcome']}' must be strictly positive")))
    if m.positive_treatment:
        reason = F.coalesce(reason, F.when(~F.coalesce(F.col("_lx") > 0, F.lit(False)),
                                           F.lit(f"Predictor '{names['treatment']}' must be strictly positive")))
    return reason


def choose_model(admissible: DataFrame, by: Sequence[str] = (), override: str | None = None) -> DataFrame:
    """First valid model (or the override, if valid) with its alternatives in order."""
    valid = F.col("status") == "valid"
    wanted = F.lit(override)
    picked = F.min_by("model", F.when(valid & ((F.col("model") == wanted) if override else F.lit(True)), F.col("rank")))
    out = group_agg(admissible, by, picked.alias("model"),
                    F.max(F.when(F.col("model") == wanted, F.col("reason"))).alias("_why"),
                    F.sort_array(F.collect_list(F.when(valid, F.struct("rank", "model")))).alias("_v"))
    alternatives = F.transform(F.filter("_v", lambda s: s["model"] != F.col("model")), lambda s: s["model"])
    if override:
        error = F.when(F.col("model").isNull(), F.coalesce(
            F.concat(F.lit(f"Override '{override}' cannot run: "), F.col("_why")),
            F.lit(f"Override '{override}' isn't valid for this question type.")))
    else:
        error = F.when(F.col("model").isNull(), F.lit("No admissible model found"))
    display = F.create_map(*[F.lit(v) for m in all_models().values() for v in (m.name, m.display_name)])
    return out.select(*by, "model", F.try_element_at(display, F.coalesce("model", F.lit(""))).alias("display_name"),
                      F.array_join(F.when(F.col("model").isNull(), F.array().cast("array<string>"))
                                   .otherwise(alternatives), ",").alias("alternatives"), error.alias("error"))
