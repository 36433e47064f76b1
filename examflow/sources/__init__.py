"""Inputs and outputs: benchmark items, the response log, derived exam views."""
