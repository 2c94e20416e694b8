"""Retrieval-memory analytics as composable DataFrame operators."""
