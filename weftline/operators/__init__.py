"""Relational operators on the graph, its documents, entities, traces and control tables."""
