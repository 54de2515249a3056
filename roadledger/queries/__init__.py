"""Registered queries: each operator on the given tables, with its SQL counterpart."""

from roadledger.queries.base import REGISTRY
from roadledger.queries import (audits, evaluation, panel_queries, segments, shapes, spending,  # noqa: F401
                                record_queries, source_queries, texts, network_queries, study_queries)
