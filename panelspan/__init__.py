"""Panel and time-series econometrics as Spark DataFrame operators."""

from .analyze import Analysis, analyze
from .operators.post import register_estimator, run_model, unregister_estimator, whatif
from .operators.profile import column_profile, dataset_structure
from .sources.files import load_table, write_results
from .spec import MODELS, ModelSpec, PanelSpec

__all__ = ["Analysis", "MODELS", "ModelSpec", "PanelSpec", "analyze", "column_profile", "dataset_structure", "load_table",
           "register_estimator", "run_model", "unregister_estimator", "whatif", "write_results"]
