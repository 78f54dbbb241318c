"""Whole retrievals: walks, fusion, lexical traces, and an engine over stored tables."""
