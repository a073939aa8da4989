"""Profiling, cleaning, features, chart data and queries for versioned tables on Spark."""

from tablewright.errors import ToolError
from tablewright.operators.charts import chart_batch, chart_data
from tablewright.operators.cleaning import apply_cleaning
from tablewright.operators.features import apply_features
from tablewright.operators.profiling import Profile, profile_table, profile_tables
from tablewright.operators.query import run
from tablewright.plans.cleaning_plan import resolve_decisions, suggest_cleaning
from tablewright.plans.chart_plan import suggest_charts
from tablewright.plans.feature_plan import suggest_features
from tablewright.sources.results import ResultStore
from tablewright.sources.tables import import_directory, import_tables, read_table
from tablewright.sources.versions import Dataset

__all__ = [
    "Dataset",
    "Profile",
    "ResultStore",
    "ToolError",
    "apply_cleaning",
    "apply_features",
    "chart_batch",
    "chart_data",
    "import_directory",
    "import_tables",
    "profile_table",
    "profile_tables",
    "read_table",
    "resolve_decisions",
    "run",
    "suggest_charts",
    "suggest_cleaning",
    "suggest_features",
]
