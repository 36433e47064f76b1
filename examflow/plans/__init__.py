"""Whole plans: an evaluation run, the registered queries, their oracle SQL."""
