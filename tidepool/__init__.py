"""Retrieval, knowledge-graph and corpus analytics expressed as Spark DataFrame jobs."""
