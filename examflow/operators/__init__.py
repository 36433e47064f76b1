"""DataFrame operators: joins, top-k, prompts, responder, scoring, log-likelihood."""
