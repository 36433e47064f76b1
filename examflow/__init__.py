"""examflow: multiple-choice exam evaluation as Spark jobs.

functions/  Column expressions (fixed values, text rules, readers, templates, tokens)
sources/    items, the response log, and exam views derived from the test tables
operators/  checked broadcast joins, map-side top-k, prompts, responder, scoring, log-likelihood
plans/      the end-to-end run, the registered queries and their DuckDB oracle SQL
streaming/  incremental report over a log folder
"""

__version__ = "0.1.0"
