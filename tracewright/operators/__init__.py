"""Operators: model graph, flow graph, traversal, selection program and solver."""
