"""Operators on whole frames: joins, aggregates, windows, paging, writes, search, lineage."""
