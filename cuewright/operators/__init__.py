"""Operators on timed-text tables. A table is keyed by ``film`` and ordered by explicit columns; times
are integer milliseconds (``start_ms``, ``end_ms``) unless a name says seconds."""
