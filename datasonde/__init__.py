"""datasonde: statistical profiles, guarded plans and drill-through on Spark tables."""

from datasonde.operators.columns import column_summaries, numeric_profile
from datasonde.operators.drill import run_tool
from datasonde.operators.findings import Profile, insights, recommendations
from datasonde.operators.health import health_score
from datasonde.operators.investigate import anomaly_drilldown, auto_investigate
from datasonde.plans.engine import run_plan
from datasonde.sources.parts import combine_parts, select_part
from datasonde.sources.sinks import profile_tables, write_profile
from datasonde.sources.tables import infer_datetimes, read_csv, read_table

__all__ = [
    "Profile",
    "anomaly_drilldown",
    "auto_investigate",
    "column_summaries",
    "combine_parts",
    "health_score",
    "infer_datetimes",
    "insights",
    "numeric_profile",
    "profile_tables",
    "read_csv",
    "read_table",
    "recommendations",
    "run_plan",
    "run_tool",
    "select_part",
    "write_profile",
]
