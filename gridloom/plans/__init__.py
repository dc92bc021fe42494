"""The registered queries and their SQL."""

from gridloom.plans import model_queries, panel_queries, rolling_queries, source_queries, summary_queries  # noqa: F401
from gridloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
