"""Spark jobs for document, graph and portfolio data."""
