"""Result schemas, the panel description and the model registry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGRESSION_SCHEMA = (
    ("model", "string"), ("status", "string"), ("error", "string"), ("outcome", "string"),
    ("treatment", "string"), ("estimate", "double"), ("intercept", "double"), ("se", "double"),
    ("t_stat", "double"), ("df", "double"), ("pvalue", "double"), ("ci_lower", "double"),
    ("ci_upper", "double"), ("significant", "boolean"), ("r_squared", "double"), ("n_obs", "long"),
    ("n_units", "long"), ("n_periods", "long"), ("x_mean", "double"), ("se_type", "string"),
    ("fe_type", "string"), ("converged", "boolean"), ("n_iter", "int"),
    ("extra", "map<string,double>"))

FORECAST_SCHEMA = (
    ("model", "string"), ("engine", "string"), ("status", "string"), ("error", "string"),
    ("h", "int"), ("time", "double"), ("forecast", "double"), ("ci_lower", "double"),
    ("ci_upper", "double"), ("last_value", "double"), ("rmse", "double"), ("aic", "double"),
    ("p", "int"), ("d", "int"), ("q", "int"), ("ar1", "double"), ("alpha", "double"),
    ("n_obs", "long"))

DIAGNOSTIC_SCHEMA = (
    ("suite", "string"), ("check_id", "string"), ("test", "string"), ("series_name", "string"),
    ("statistic", "double"), ("pvalue", "double"), ("status", "string"),
    ("interpretation", "string"), ("correction", "string"), ("detail", "map<string,double>"))


def shape_rows(df: DataFrame, schema: tuple[tuple[str, str], ...], by: Sequence[str],
               values: dict[str, Column]) -> DataFrame:
    """Project to a result schema: ``by`` keys first, columns that are not given become NULL."""
    return df.select(*by, *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in schema])


@dataclass(frozen=True)
class PanelSpec:
    """Which columns play which role. ``treatment`` is the predictor of interest."""

    outcome: str
    treatment: str | None = None
    unit: str | None = None
    time: str | None = None
    question_type: str = "association"


@dataclass(frozen=True)
class ModelSpec:
    name: str
    question_type: str
    display_name: str
    required: tuple[str, ...]
    needs_panel: bool = False
    needs_variation: bool = False
    positive_outcome: bool = False
    positive_treatment: bool = False


_PANEL = ("outcome", "treatment", "unit", "time")
_LINE = ("outcome", "treatment")

# Model names, display names and needs, in order of preference per question type.
MODELS: dict[str, ModelSpec] = {m.name: m for m in (
    ModelSpec("diff_in_diff", "causal_effect", "Difference-in-Differences (TWFE)", _PANEL, True, True),
    ModelSpec("arima", "forecast", "ARIMA (auto-order)", ("outcome", "time")),
    ModelSpec("linear_trend", "forecast", "Linear trend forecast", ("outcome", "time")),
    ModelSpec("exp_smoothing", "forecast", "Simple exponential smoothing", ("outcome", "time")),
    ModelSpec("random_walk", "forecast", "Random walk / naive forecast", ("outcome", "time")),
    ModelSpec("panel_ols", "association", "Panel OLS (Two-Way FE)", _PANEL, True, True),
    ModelSpec("entity_fe", "association", "Entity fixed effects", ("outcome", "treatment", "unit"),
              False, True),
    ModelSpec("time_fe", "association", "Time fixed effects", ("outcome", "treatment", "time")),
    ModelSpec("first_difference", "association", "First-difference regression", _PANEL, True),
    ModelSpec("ols", "association", "OLS (cross-sectional)", _LINE),
    ModelSpec("pooled_ols", "association", "Pooled OLS", _LINE),
    ModelSpec("log_linear", "association", "Log-linear regression", _LINE, positive_outcome=True),
    ModelSpec("log_log", "association", "Log-log regression", _LINE, positive_outcome=True,
              positive_treatment=True),
    ModelSpec("polynomial_ols", "association", "Quadratic / polynomial OLS", _LINE),
    ModelSpec("median_quantile", "association", "Median quantile regression", _LINE),
)}

PREFERENCE: dict[str, tuple[str, ...]] = {
    # first_difference is an alternative here so that a failed pre-trend test has somewhere to go
    "causal_effect": ("diff_in_diff", "first_difference"),
    "forecast": ("arima", "linear_trend", "exp_smoothing", "random_walk"),
    "association": ("panel_ols", "entity_fe", "time_fe", "first_difference", "ols", "pooled_ols",
                    "log_linear", "log_log", "polynomial_ols", "median_quantile"),
}


_ADDED: dict[str, tuple[ModelSpec, str | None]] = {}


def add_model(spec: ModelSpec, before: str | None = None) -> None:
    """Let a further model be a candidate for its question type: before the model named, or after all others.

    Adding a name again replaces what it stood for; names of the registry cannot be taken.
    """
    if spec.name in MODELS:
        raise ValueError(f"'{spec.name}' is a model of the registry")
    if spec.question_type not in PREFERENCE:
        raise ValueError(f"no question type '{spec.question_type}': there are {', '.join(PREFERENCE)}")
    odd = [r for r in spec.required if r not in _PANEL]
    if odd or "outcome" not in spec.required:
        raise ValueError(f"required fields are outcome and any of treatment, unit and time, not {', '.join(odd) or 'none of them'}")
    _ADDED.pop(spec.name, None)
    if before is not None and before not in candidates(spec.question_type):
        raise ValueError(f"'{before}' is no candidate for {spec.question_type}")
    _ADDED[spec.name] = (spec, before)


def drop_model(name: str) -> None:
    """Take an added model back."""
    _ADDED.pop(name, None)


def all_models() -> dict[str, ModelSpec]:
    return MODELS | {name: spec for name, (spec, _) in _ADDED.items()}


def candidates(question_type: str) -> tuple[str, ...]:
    """Models of a question type in order of preference, added ones in their places."""
    out = list(PREFERENCE[question_type])
    for name, (spec, before) in _ADDED.items():
        if spec.question_type == question_type:
            out.insert(out.index(before) if before in out else len(out), name)
    return tuple(out)
