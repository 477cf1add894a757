"""Landed inputs as document tables, and the tables a scan writes."""
