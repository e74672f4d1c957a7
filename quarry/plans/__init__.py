"""Registered jobs over the benchmark tables (one per operator key)."""
