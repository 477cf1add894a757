"""Recurring scans as streaming queries."""
