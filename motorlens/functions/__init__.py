"""Column expressions and small reusable frame helpers."""
