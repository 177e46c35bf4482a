"""One call from a table and its roles to result tables.

The order is: prepare, choose an admissible model, check its assumptions, switch if a critical check
fails and a better model is admissible, estimate (falling back to the next admissible model, and from a
causal to an association question), then everything that follows an estimate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .functions.columns import is_numeric
from .operators import diagnostics as D
from .operators import forecast as FC
from .operators import post as PO
from .operators import prepare as PP
from .operators import tables as TB
from .plans.scale import materialise
from .spec import PanelSpec


@dataclass
class Analysis:
    """Result tables of one analysis. All are DataFrames; ``notes`` tells what was decided on the way."""

    spec: PanelSpec
    model: str | None
    admissible: DataFrame
    checks: DataFrame | None = None
    result: DataFrame | None = None
    texts: DataFrame | None = None
    score: DataFrame | None = None
    eras: DataFrame | None = None
    insights: DataFrame | None = None
    followups: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def _ranked(admissible: DataFrame) -> list[str]:
    """Valid model names in order (at most one row per model of the registry)."""
    return [r["model"] for r in admissible.where(F.col("status") == "valid").orderBy("rank").select("model").collect()]


def _checks(df: DataFrame, spec: PanelSpec, model: str) -> DataFrame:
    suite = D.pick_diagnostics(model)
    if suite is D.arima_diagnostics:
        return suite(df, spec.outcome, spec.time)
    if suite is D.did_diagnostics and spec.time and spec.unit:
        return suite(df, spec.outcome, spec.treatment, spec.time, spec.unit)
    return D.ols_diagnostics(df, spec.outcome, spec.treatment)


def _run(df: DataFrame, spec: PanelSpec, model: str, periods: int) -> DataFrame:
    if model in FC.MODELS:
        return FC.MODELS[model](df, spec.outcome, spec.time, periods)
    return PO.run_model(df, model, spec.outcome, spec.treatment, spec.time, spec.unit)


def _worked(result: DataFrame) -> bool:
    return bool(result.where(F.col("status") == "ok").limit(1).count())


def analyze(df: DataFrame, spec: PanelSpec, periods: int = 10, unit_value=None, lag: int = 0, override: str | None = None,
            events: Sequence[tuple[float, str]] = ()) -> Analysis:
    """Run the whole chain for one question. Use the operators with ``by`` to fit many groups at once."""
    notes: list[str] = []
    if unit_value is not None and spec.unit:
        df, spec = PP.filter_unit(df, spec.unit, unit_value), replace(spec, unit=None)
        notes.append(f"filtered to {unit_value}: one series, no panel")
    if spec.outcome in df.columns and not is_numeric(df, spec.outcome):
        found = PP.numeric_outcome_fallback(df, spec.outcome)
        if found != spec.outcome:
            notes.append(f"outcome '{spec.outcome}' is not numeric: using '{found}'")
            spec = replace(spec, outcome=found)
    if lag and spec.treatment and spec.time:
        df = PP.lag_predictor(df, spec.treatment, spec.time, spec.unit, lag)
        spec = replace(spec, treatment=f"{spec.treatment}_lag{lag}")
        notes.append(f"using the predictor {lag} period(s) earlier")

    admissible = materialise(PP.admissible_models(df, spec))
    order = _ranked(admissible)
    if spec.question_type == "causal_effect" and "diff_in_diff" not in order and not override:
        notes.append("no admissible causal model: measuring the association instead")
        spec = replace(spec, question_type="association")
        admissible = materialise(PP.admissible_models(df, spec))
        order = _ranked(admissible)
    if override:
        if override not in order:
            why = admissible.where(F.col("model") == override).select("reason").first()
            notes.append(f"override '{override}' cannot run: {why['reason'] if why else 'not a model for this question'}")
            return Analysis(spec, None, admissible, notes=notes)
        order = [override, *[m for m in order if m != override]]
    if not order:
        notes.append("no admissible model found")
        return Analysis(spec, None, admissible, notes=notes)

    model = order[0]
    checks = materialise(_checks(df, spec, model))
    if not override:
        chosen = df.sparkSession.range(1).select(F.lit(model).alias("model"))
        better = D.corrective_switch(checks, chosen, admissible).first()
        if better["final_model"] != model:
            notes.append(f"{model} -> {better['final_model']}: {better['because']} failed")
            model = better["final_model"]
            checks = materialise(_checks(df, spec, model))
    result = materialise(_run(df, spec, model, periods))
    queue = [] if override else [m for m in order if m != model]
    while not _worked(result):
        if not queue and spec.question_type == "causal_effect" and not override:
            spec = replace(spec, question_type="association")
            admissible = materialise(PP.admissible_models(df, spec))
            queue = [m for m in _ranked(admissible) if m not in order]
            notes.append("causal models failed: measuring the association instead")
        if not queue:
            return Analysis(spec, model, admissible, checks, result, notes=notes)
        notes.append(f"{model} could not run: trying {queue[0]}")
        model = queue.pop(0)
        checks = materialise(_checks(df, spec, model))
        result = materialise(_run(df, spec, model, periods))

    out = Analysis(spec, model, admissible, checks, result, notes=notes)
    if model in FC.MODELS:
        out.texts = TB.forecast_summary(result)
        named = result.select("model").distinct().select("model", F.lit(spec.outcome).alias("outcome"), F.lit(spec.treatment).cast("string").alias("treatment"))
    else:
        out.texts = TB.result_texts(result, causal=spec.question_type == "causal_effect")
        if spec.time and spec.time in df.columns:
            out.eras = materialise(PO.era_effects(df, model, spec.outcome, spec.treatment, spec.time, spec.unit, events))
        out.score = PO.confidence_score(result, checks, out.eras)
        law = result.select(X.known_law(F.col("outcome"), F.col("treatment"))["law"].alias("law"))
        out.insights = PO.insights(df, result, spec.outcome, spec.treatment, spec.time, spec.unit, law)
        named = result.select("model", "outcome", "treatment")
    out.followups = named.select("model", F.explode(X.followups(F.col("model"), F.col("outcome"), F.col("treatment"))).alias("suggestion"))
    return out
