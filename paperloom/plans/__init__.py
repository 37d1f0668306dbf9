"""Query plans and their SQL counterparts."""
