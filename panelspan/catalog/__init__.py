"""Registered queries over the standard tables, each with the SQL that checks it where SQL can."""

from . import estimates, forecasts, prepared, profiles, reports        # noqa: F401
from .base import ORACLES, QUERIES                                      # noqa: F401
