"""Extraction, rules, aggregation, graph, diff and verification operators."""
