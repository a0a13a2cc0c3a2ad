"""Name to query, and name to the SQL that must agree with it."""

from tendermill.plans import checklist_queries, lot_queries, report_queries, stream_queries, tender_queries, text_queries  # noqa: F401
from tendermill.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "go_no_go"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
