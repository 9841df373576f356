"""DataFrame operators: rewrites, preparation, scoring, statistics."""
