"""Pipelines and structured queries, composed of operators."""
