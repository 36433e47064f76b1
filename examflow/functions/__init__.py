"""Column expressions: fixed values, text rules, answer readers, templates, token counters."""
