"""Scan pipelines: landed tables in, (findings, scores, summary) out."""
