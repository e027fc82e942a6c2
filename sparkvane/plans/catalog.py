"""All registered queries; importing the modules registers them."""

from sparkvane.plans import q_more, q_quality, q_rows, q_rules, q_sources, q_text  # noqa: F401
from sparkvane.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
