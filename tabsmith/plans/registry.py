"""All registered plans: ``QUERIES`` (name -> builder) and ``ORACLE`` (name -> SQL)."""

from tabsmith.plans import evaluation, lifecycle, model, relational, storage  # noqa: F401  (registration side effects)
from tabsmith.plans.base import COVERS, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "COVERS"]
