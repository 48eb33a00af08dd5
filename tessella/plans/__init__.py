"""All registered queries over the library's operators."""

from tessella.plans import case_plans, table_plans, text_plans
from tessella.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "case_plans", "table_plans", "text_plans"]
