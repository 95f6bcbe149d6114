"""DataFrame-to-DataFrame operators: lazy, deterministic, no driver round trips."""
