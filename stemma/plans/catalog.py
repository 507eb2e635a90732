"""Imports every module that registers queries."""

from stemma.plans import contract_queries, document_queries, equation_queries, further_queries, layout_queries, reconstruction_queries, text_queries, workflow_queries  # noqa: F401
