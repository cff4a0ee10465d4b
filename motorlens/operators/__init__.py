"""DataFrame-to-DataFrame operators, grouped by subject."""
