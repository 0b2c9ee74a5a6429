"""All registered queries: importing this module fills the registry."""

from . import answer_queries, dml_queries, discovery_queries, filing_queries, planner_queries, relational_queries, search_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES, flagship  # noqa: F401
