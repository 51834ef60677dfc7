"""All registered queries."""

from __future__ import annotations

from cairnflow.plans import asset_queries, builder_queries, code_queries, entity_queries, evaluation_queries, log_queries, lookup_queries, misc_queries, quantizer_queries, subset_queries, text_queries, vector_queries  # noqa: F401
from cairnflow.plans.base import QUERIES, SQL
