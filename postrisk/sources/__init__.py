"""Scans and sinks (post tables, reports, splits, models) and the fixture tables."""
