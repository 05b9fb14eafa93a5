"""Arbitration, graph, artifact, scoring and the end-to-end plan."""
