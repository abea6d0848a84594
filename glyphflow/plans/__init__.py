"""Registered queries of the engine's operators, and their SQL."""
