"""Registered queries of the reference's operators, with the same results as SQL where SQL can express them."""

from tidepool.plans import analysis, corpus, graph, lookups, pipelines, reasoning, retrieval, stores, stream, text
from tidepool.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analysis", "corpus", "graph", "lookups", "pipelines", "reasoning", "retrieval", "stores", "stream", "text"]
