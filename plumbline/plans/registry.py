"""Queries by name, and their SQL."""

from plumbline.plans import reports  # noqa: F401  registers its queries
from plumbline.plans.queries import QUERIES, SQL  # noqa: F401
